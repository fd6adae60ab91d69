"""DuckDB SQL for the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from loomtext.llm import mixing, sharding

_SPACES = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP8 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

OP9 = f"""
WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT depth, hash >> ({sharding.BITS} - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs
      FROM t, (SELECT CAST(range AS INTEGER) AS depth FROM range({sharding.BITS + 1})) GROUP BY 1, 2),
leaf AS (SELECT t.doc_id, min(depth) AS depth FROM t, s WHERE s.prefix = t.hash >> ({sharding.BITS} - depth) AND (shard_bytes <= {sharding.LIMIT} OR shard_docs = 1 OR depth = {sharding.BITS}) GROUP BY 1)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes <= {sharding.LIMIT} AS fits
FROM t JOIN leaf USING (doc_id) JOIN s USING (depth) WHERE s.prefix = hash >> ({sharding.BITS} - depth)
"""

_REST = "{0}[prompt_turns + 1:]"
_TEXT = "array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '')"
_SPANS = """array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: length(t.role) + length(t.text) + 6)), 0) + length({0}[i].role) + 5 AS BIGINT) || ':' ||
    CAST(coalesce(list_sum(list_transform({0}[1:i], lambda t: length(t.role) + length(t.text) + 6)), 0) AS BIGINT)), ',')"""

OP4 = f"""
WITH talk AS (SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT *, {{'role': turns[1].role, 'text': turns[1].text}} AS first, turns[-1].role <> 'assistant' AS open FROM talk),
g AS (SELECT first, arg_min(conv_id, (open, conv_id)) AS chosen_id, count(*) AS n FROM k GROUP BY first),
p AS (SELECT g.chosen_id, CASE WHEN n > 1 THEN k.conv_id END AS rejected_id, b.turns AS chosen, CASE WHEN n > 1 THEN k.turns END AS rejected
      FROM g JOIN k USING (first) JOIN talk b ON b.conv_id = g.chosen_id WHERE n = 1 OR k.conv_id <> g.chosen_id),
q AS (SELECT *, CAST(CASE WHEN rejected IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1),
      lambda i: chosen[i].role = rejected[i].role AND chosen[i].text = rejected[i].text), false) - 1, least(len(chosen), len(rejected))) END AS INTEGER) AS prompt_turns FROM p),
c AS (SELECT *, {_REST.format("chosen")} AS cr, {_REST.format("rejected")} AS rr FROM q)
SELECT chosen_id, coalesce(rejected_id, -1) AS rejected_id, prompt_turns, {_TEXT.format("chosen[1:prompt_turns]")} AS prompt,
       {_TEXT.format("cr")} AS chosen_completion, {_SPANS.format("cr")} AS chosen_spans,
       coalesce({_TEXT.format("rr")}, '') AS rejected_completion, coalesce({_SPANS.format("rr")}, '') AS rejected_spans
FROM c
"""

_A_Z = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_A_Z.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (lang_n + 5) // (lang_total + 5 * v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 50
"""

_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr({0}, 5 * i + 1, 5))::INTEGER >> b) & 31) + 1]), '')), '')"

OP12 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS r FROM pages),
f AS (SELECT html, page_id AS first FROM p WHERE r = 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32.format("sha1(html)")} AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r > 1 THEN first END AS refers_to, url AS target_uri FROM p JOIN f USING (html)
"""

_CUT = "length(text) > 0 AND NOT contains(text, '<P>') AND NOT contains(text, '<S>') AND NOT contains(text, '<M>') AND h[3] % 100 < 90"

OP13 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(range(4), lambda i: ('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8))::BIGINT) AS h FROM documents),
c AS (SELECT *, length(text) AS n, least(h[1] % (length(text) + 1), h[2] % (length(text) + 1)) AS a, greatest(h[1] % (length(text) + 1), h[2] % (length(text) + 1)) AS b,
      CASE WHEN NOT ({_CUT}) THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
o AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""


def oracle_sql():
    return {"op4_preference": OP4, "op8_exact_dedup": OP8, "op9_sharding": OP9, "op11_divergence": OP11, "op12_warc": OP12, "op13_fill_middle": OP13}
