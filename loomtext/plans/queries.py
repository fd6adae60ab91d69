"""Queries by name, each with the SQL that says the same where SQL can (``ORACLE``).

Inputs are whole tables.  Where the tables lack what a rule is about, such as wiki markup, the input is made from every
document by SQL that both engines read (``*_SQL``), or is a small table of cases.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from loomtext.config import SKIPPED_TITLES
from loomtext.functions import html, normalize, text
from loomtext.functions.normalize import CLOSE_ORPHAN, HEADING, LINK, OPEN_ORPHAN, TABLE, TAIL, TEMPLATE, URL
from loomtext.functions.text import SPACE, WORD
from loomtext.operators import chat, dedup, gates, lookup, metrics, mix, parse, recall, seen, tokens, training, vocab
from loomtext.operators.recall import FACTS, PREFERENCES
from loomtext.session import saved, shared_folder
from loomtext.sources import readers, shapes, writers
from loomtext.sources.flat import FlatTokens
from loomtext.streaming import loop

QUERIES, ORACLE = {}, {}
SOURCES = {f"src{i}": [5.0, 2.0, 1.0, 0.5][i % 4] for i in range(20)}

WIKI_SQL = """SELECT doc_id, concat('{{infobox|a={{b}}|c}}', chr(10), '== Titre ==', chr(10), text, ' [[Page|lien]] [[Autre]] &nbsp;&eacute;&#233; <b>gras</b> https://ex.org/a?b  x',
chr(10), chr(10), chr(10), chr(10), '{| t', chr(10), '|a |}', '   ', chr(10), '  fin [[Catégorie:Z]] {{ouvert', chr(10), 'reste }} apres', chr(10), 'Voir aussi', chr(10), 'x') AS text FROM documents"""
BROKEN_SQL = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(replace(text, chr(10), concat(chr(92), 'n')), concat(chr(92), 't')) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), concat(chr(13), chr(10)))
ELSE concat(text, chr(10), 'Notes et références', chr(10), 'x') END AS text FROM documents"""
#: A text on one line, without what JSON would escape.
SAFE = "translate(coalesce(text, ''), concat(chr(9), chr(10), chr(13), chr(34), chr(92)), '     ')"
LINES_SQL = f"""SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('{{"text":"', {SAFE}, '","source":"', coalesce(source, ''), '"}}') WHEN 1 THEN concat('{{', {SAFE}) WHEN 2 THEN concat('[', doc_id, ']')
WHEN 3 THEN concat('"', {SAFE}, '"') WHEN 4 THEN '{{"text":null}}' ELSE concat('{{"source":"', coalesce(source, ''), '","n":', doc_id, '}}') END AS line FROM documents"""
FACTS_SQL = "SELECT doc_id AS pos, text AS fact FROM documents"


def query(sql=None):
    """Registers a query under its function's name; ``sql`` may be a list of one function that makes it later."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark, sf_dir, sql):
    """The rows of an input that is made by SQL over the tables."""
    return spark.sql(re.sub(r"FROM (documents|conversations|events|benchmark|lineitem|part)\b", rf"FROM parquet.`{sf_dir}/\1.parquet`", sql))


def scratch(spark, name):
    """A path for a sink's query, in the cluster's shared folder."""
    return f"{shared_folder(spark)}/sinks/{name}-{uuid.uuid4().hex}"


# DuckDB spellings
def _sub(x, pattern, to="", flags="g"):
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2).replace('(?dm)', '(?m)')}', '{to}', '{flags}')"


def _strip(x):
    return _sub(x, f"^[{SPACE}]+|[{SPACE}]+$")


def _words(x):
    return f"regexp_extract_all({x}, '{WORD}')"


def _tail(x):
    """Cut at the tail section, for a column x."""
    lines = f"string_split({x}, chr(10))"
    at = f"list_min(list_filter(range(1, len({lines}) + 1), lambda i: regexp_matches({_strip(f'lower({lines}[i])')}, '{TAIL}')))"
    return f"CASE WHEN {at} IS NULL THEN {x} ELSE {_sub(f'array_to_string({lines}[1:{at} - 1], chr(10))', f'[{SPACE}]+$')} END"


def _repaired(x):
    t = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lit, nl = f"(length({t}) - length(replace({t}, chr(92) || 'n', ''))) / 2", f"(length({t}) - length(replace({t}, chr(10), '')))"
    return f"CASE WHEN {lit} >= 2 AND {nl} < {lit} THEN replace(replace({t}, chr(92) || 'n', chr(10)), chr(92) || 't', ' ') ELSE {t} END"


def _nested(x, pattern, rounds):
    for _ in range(rounds):
        x = _sub(x, pattern)
    return x


def _steps(source, *steps):
    """One CTE for each step, so that an expression that uses its input several times stays small."""
    out = f"WITH t0 AS ({source})"
    for i, step in enumerate(steps):
        out += f", t{i + 1} AS MATERIALIZED (SELECT doc_id, {step('text')} AS text FROM t{i})"
    return out + f" SELECT doc_id, text FROM t{len(steps)}"


def _templates(x):
    return _sub(_sub(_nested(x, TEMPLATE, 20), OPEN_ORPHAN), CLOSE_ORPHAN)


def _tidy(x):
    for p, to in ((" {2,}", " "), (r"\n{3,}", r"' || chr(10) || chr(10) || '"), (r"[ \t]+\n", r"' || chr(10) || '"), (r"\n[ \t]+", r"' || chr(10) || '")):
        x = _sub(x, p, to)
    return x


_HEAD = lambda x: _sub(x, HEADING, r"' || chr(10) || chr(10) || '\1' || chr(10) || chr(10) || '")
_TAGS = lambda x: _sub(_sub(x, "<[^>]+>"), r"&nbsp;?|&[a-z]+;|&#[0-9]+;", " ")
_MEDIA = lambda x: _sub(x, r"(?i)\[\[(?:Catégorie|Category|Fichier|File):[^\]]*\]\]")
ALPHA = r"\p{L}"


# --- scans and sources
@query("SELECT id, CASE WHEN ok THEN json_extract_string(line, '$.text') END AS text, CASE WHEN ok THEN json_extract_string(line, '$.source') END AS source, CASE WHEN NOT ok THEN line END AS bad "
       f"FROM (SELECT *, CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END AS ok FROM ({LINES_SQL}))")  # fmt: skip
def s1_jsonl(spark, sf_dir):
    return readers.parsed_lines(made(spark, sf_dir, LINES_SQL), "text string, source string").withColumnRenamed("_bad", "bad")


@query(f"WITH r AS (SELECT doc_id, {_repaired('text')} AS text FROM ({BROKEN_SQL})), c AS (SELECT doc_id, {_tail('text')} AS text FROM r) SELECT length(text) AS n_chars FROM c WHERE length(text) >= 100")
def s2_corpus(spark, sf_dir):
    at = scratch(spark, "s2")
    writers.json_lines(made(spark, sf_dir, BROKEN_SQL).select("text"), at)
    return readers.corpus(spark, at).select(F.length("text").alias("n_chars"))


@query(f"SELECT chars, count(*) AS n_docs FROM (SELECT length(text) AS chars FROM (SELECT doc_id, {_repaired('text')} AS t FROM documents) d, LATERAL (SELECT {_tail('t')} AS text) WHERE length(text) >= 100 UNION ALL SELECT length(text) + 1 FROM benchmark WHERE length(text) >= 99) GROUP BY chars")
def s2_corpus_of_both(spark, sf_dir):
    """JSON lines, and text files of one text each, under a cap that the lines do not fill."""
    at, texts = scratch(spark, "s2"), scratch(spark, "s2-texts")
    docs = table(spark, sf_dir, "documents")
    writers.json_lines(docs.select("text"), at)
    table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(texts)
    both = readers.corpus(spark, at, texts, max_docs=docs.count() + 1)
    return both.groupBy(F.length("text").alias("chars")).agg(F.count("*").alias("n_docs"))


DUMP_SQL = f"SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'Talk:' WHEN doc_id % 7 = 0 THEN 'Catégorie:' ELSE '' END, doc_id) AS title, concat(CASE WHEN doc_id % 11 = 0 THEN '#redirect ' ELSE '' END, text) AS text FROM ({WIKI_SQL}) w"
_WIKITEXT = [(p.replace("(?iu)", "(?i)"), to.replace("$", chr(92)).replace(chr(10), "' || chr(10) || '")) for p, to in normalize.WIKITEXT]


def _wikitext(x):
    for p, to in _WIKITEXT:
        x = _sub(x, p, to)
    return _strip(x)


@query(f"SELECT title, text, length(text) AS chars FROM (SELECT title, {_wikitext('text')} AS text FROM ({DUMP_SQL}) WHERE NOT ({' OR '.join(f'starts_with(title, {chr(39)}{p}{chr(39)})' for p in SKIPPED_TITLES)}) AND NOT contains(upper(text), '#REDIRECT')) WHERE length(text) >= 300")
def s3_dump_articles(spark, sf_dir):
    return readers.articles(made(spark, sf_dir, DUMP_SQL).drop("doc_id"), min_chars=300)


@query("SELECT doc_id, doc_id % 30 AS score FROM documents WHERE doc_id % 30 >= 10 AND doc_id % 3 <> 0 AND text <> ''")
def s5_forum_posts(spark, sf_dir):
    posts = made(spark, sf_dir, "SELECT doc_id, doc_id % 30 AS score, doc_id % 3 <> 0 AS is_self, text AS selftext FROM documents")
    return readers.forum_posts(posts).select("doc_id", "score")


@query()
def s6_web_pages(spark, sf_dir):
    return readers.web_pages(table(spark, sf_dir, "pages"))


@query()
def s7_crawl(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter("url is not null")
    found = p.select(F.col("url").alias("from_url"), F.posexplode(html.resolved(F.col("url"), html.hrefs(F.col("html")))).alias("pos", "href"))
    start = p.agg(F.min("url").alias("u")).first()["u"]
    return readers.crawl(found, start or "http://none/", 50)


@query()
def s7_crawl_hosts(spark, sf_dir):
    """All hosts at once, each from its least address."""
    p = table(spark, sf_dir, "pages").filter("url is not null")
    found = p.select(F.col("url").alias("from_url"), F.posexplode(html.resolved(F.col("url"), html.hrefs(F.col("html")))).alias("pos", "href"))
    return readers.crawl_hosts(found, p.select("url"), 50)


@query("SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def s10_conversations(spark, sf_dir):
    c = chat.turns(table(spark, sf_dir, "conversations"))
    line = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))))
    return readers.conversations_json(c.select("conv_id", line.alias("line"))).select("conv_id", F.size("messages").cast("long").alias("n_messages"))


@query("SELECT event_id, value FROM events")
def s11_log_lines(spark, sf_dir):
    at = scratch(spark, "s11")
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(F.to_json(F.struct("event_id", "value")), F.lit("{bad"), F.lit("[1]"))).alias("value"))
    lines.write.text(at)
    return readers.log_lines(spark.read.text(at).withColumnRenamed("value", "line"), "event_id bigint, value double")


@query(f"SELECT doc_id, t AS text FROM (SELECT doc_id, lang, {_strip('text')} AS t FROM documents) WHERE coalesce(lower(lang), '') IN ('', 'fr', 'en') AND length(t) > 30")
def s8_messages(spark, sf_dir):
    return shapes.messages_in_languages(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "text")


def _listed(spark, sf_dir, role, text):
    turns = chat.turns(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text))).alias("x"))


_SAID = "'<|' || {role} || '|>' || chr(10) || {text} || chr(10)"


def _chat_sql(role, where, more_than):
    line = _SAID.format(role=role, text=_strip("text"))
    return f"SELECT * FROM (SELECT conv_id, string_agg({line}, '' ORDER BY turn, role, text) AS text FROM conversations WHERE {_strip('text')} <> '' AND {where} GROUP BY conv_id) WHERE length(text) > {more_than}"


@query(_chat_sql("lower(role)", "lower(role) IN ('user', 'assistant')", 0))
def s8_chats(spark, sf_dir):
    return shapes.chats(_listed(spark, sf_dir, "role", "content"), "x").select("conv_id", "text")


@query(_chat_sql("CASE WHEN role = 'human' THEN 'user' ELSE 'assistant' END", "true", 100))
def s8_shared_chats(spark, sf_dir):
    return shapes.shared_chats(_listed(spark, sf_dir, "from", "value"), "x").select("conv_id", "text")


@query(f"SELECT doc_id, t AS text FROM (SELECT doc_id, {_strip('text')} AS t FROM documents) WHERE length(t) > 500")
def s8_encyclopedia(spark, sf_dir):
    return shapes.encyclopedia(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, substr(text, 1, 2000) AS text FROM documents WHERE length(text) >= 200 AND len({_words('text')}) >= 30 AND len(list_distinct({_words('text')})) / len({_words('text')}) >= 0.3 ORDER BY doc_id LIMIT 300")
def s8_filtered_web(spark, sf_dir):
    return shapes.filtered_web(table(spark, sf_dir, "documents").select("doc_id", "text"), 300)


_ASKED_SQL = "SELECT doc_id, '<|user|>' || chr(10) || {asked} || chr(10) || '<|assistant|>' || chr(10) || {said} || chr(10) AS text FROM documents WHERE {strip} <> ''"


@query(_ASKED_SQL.format(asked="source || chr(10) || lang", said=_strip("text"), strip=_strip("text")))
def s8_instructions(spark, sf_dir):
    return shapes.instructions(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.col("lang").alias("context"), F.col("text").alias("response"))).select("doc_id", "text")


@query(_ASKED_SQL.format(asked="source", said=_strip("text"), strip=_strip("text")))
def s8_questions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("question"), F.struct(F.array("text", F.lit("other")).alias("text")).alias("answers"))
    return shapes.questions(d).select("doc_id", "text")


@query(_ASKED_SQL.format(asked="source", said="'```' || chr(10) || " + _strip("text") + " || chr(10) || '```'", strip=_strip("text")))
def s8_code(spark, sf_dir):
    return shapes.code(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.col("text").alias("output"))).select("doc_id", "text")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS shard_id FROM documents")
def k3_shards(spark, sf_dir):
    return mix.shard_ids(table(spark, sf_dir, "documents").select("doc_id"), 100)


@query("SELECT doc_id, length(text) AS n_chars FROM documents")
def k1_json_lines(spark, sf_dir):
    at = scratch(spark, "k1")
    writers.json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), at)
    return readers.jsonl(spark, at, "doc_id bigint, text string").select("doc_id", F.length("text").alias("n_chars"))


@query("SELECT doc_id, length(text) >= 200 AS is_new FROM documents")
def k2_replaced(spark, sf_dir):
    at = scratch(spark, "k2")
    writers.json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), at)
    writers.replaced(spark, spark.read.json(at).filter(F.length("text") >= 200), at)
    new = spark.read.json(at).select("doc_id", F.lit(True).alias("_new"))
    return spark.read.json(at + ".bak").join(new, "doc_id", "left").select("doc_id", F.coalesce("_new", F.lit(False)).alias("is_new"))


@query("SELECT l_partkey AS their_id, l_suppkey AS our_id FROM lineitem")
def k7_cached_map(spark, sf_dir):
    at = scratch(spark, "k7")
    writers.cached_map(spark, lambda: made(spark, sf_dir, _EDGES), at, 32, 64)

    def never():
        raise AssertionError("the map is there already")

    return writers.cached_map(spark, never, at, 32, 64)


@query("SELECT event_id, CAST(2 AS BIGINT) AS n FROM events")
def k8_appended(spark, sf_dir):
    at = scratch(spark, "k8")
    for _ in range(2):
        writers.appended(table(spark, sf_dir, "events").select("event_id", "value"), at)
    return spark.read.json(at).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def k9_longest_conversations(spark, sf_dir):
    # each conversation as it was saved after every turn, told apart by a first turn of its own and an opening that all share
    c = chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", F.concat(F.array(F.struct(F.lit("user").alias("role"), F.lit("Bonjour").alias("content")), F.struct(F.lit("user").alias("role"), F.col("conv_id").cast("string").alias("content"))), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"))
    saved = c.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("messages")), lambda i: F.slice("messages", F.lit(1), i))).alias("messages"))
    return writers.longest_versions(saved).select(F.get("messages", F.lit(1))["content"].cast("long").alias("conv_id"), (F.size("messages") - 2).cast("long").alias("n"))


@query("SELECT event_id, event, sink FROM (SELECT event_id, event, CASE event WHEN 'error' THEN 3 WHEN 'milestone' THEN 2 ELSE 1 END AS i FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'milestone' ELSE 'info' END AS event FROM events)), "
       "(VALUES ('console', 1), ('file', 2), ('http', 3)) s(sink, least) WHERE i >= least")  # fmt: skip
def k10_notifications(spark, sf_dir):
    events = made(spark, sf_dir, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'milestone' ELSE 'info' END AS event FROM events")
    return writers.routed(events, {"console": 1, "file": 2, "http": 3})


# --- normalisation
def _normalised(name, column, sql, source=WIKI_SQL):
    def run(spark, sf_dir):
        return made(spark, sf_dir, source).select("doc_id", column(F.col("text")).alias("text"))

    run.__name__ = name
    query(sql)(run)


_normalised("n1_newline_repair", normalize.newline_repair, f"SELECT doc_id, {_repaired('text')} AS text FROM ({BROKEN_SQL})", BROKEN_SQL)
_normalised("n2_wiki_tail", normalize.wiki_tail_cut, f"SELECT doc_id, {_tail('text')} AS text FROM ({WIKI_SQL})")
_normalised("n3_nfkc", normalize.nfkc, None, "SELECT doc_id, concat(text, '\ufb01\uff12\u00a0e\u0301') AS text FROM documents")
_normalised("n4_templates", normalize.without_templates, f"SELECT doc_id, {_templates('text')} AS text FROM ({WIKI_SQL})")
_normalised("n5_tables", normalize.without_tables, f"SELECT doc_id, {_nested('text', TABLE, 10)} AS text FROM ({WIKI_SQL})")
_normalised("n6_links", normalize.unwrapped_links, f"SELECT doc_id, {_sub('text', LINK, chr(92) + '1')} AS text FROM ({WIKI_SQL})")
_normalised("n7_headings", normalize.plain_headings, f"SELECT doc_id, {_HEAD('text')} AS text FROM ({WIKI_SQL})")
_normalised("n8_tags", normalize.without_tags, f"SELECT doc_id, {_TAGS('text')} AS text FROM ({WIKI_SQL})")
_normalised("n9_urls", normalize.without_urls, f"SELECT doc_id, {_sub('text', URL)} AS text FROM ({WIKI_SQL})")
_normalised("n10_media_links", normalize.without_media_links, f"SELECT doc_id, {_MEDIA('text')} AS text FROM ({WIKI_SQL})")
_normalised("n11_spaces", normalize.tidy_spaces, f"SELECT doc_id, {_tidy('text')} AS text FROM ({WIKI_SQL})")
_CLEAN = (_repaired, _tail, _templates, lambda x: _nested(x, TABLE, 10), lambda x: _sub(x, LINK, r"\1"), _HEAD, _TAGS, lambda x: _sub(x, URL), _MEDIA, _tidy, _tail, _strip)
_normalised("n12_clean", lambda t: normalize.clean(t, unicode=False), _steps(WIKI_SQL, *_CLEAN))
_normalised("n13_wikitext", normalize.clean_wikitext, f"SELECT doc_id, {_wikitext('text')} AS text FROM ({WIKI_SQL})")
_normalised("n14_cut", lambda t: text.cut(t, 2000), "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents", "SELECT doc_id, text FROM documents")


@query()
def h1_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


_PIECES = f"list_filter(list_transform(regexp_split_to_array({_sub('html', html.NO_TEXT, '<x>')}, '<[^>]*>'), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT page_id, replace(replace(replace(replace(replace(array_to_string({_PIECES}, chr(10)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages")
def h1_page_text_by_pattern(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_text_approx(F.col("html")).alias("text"))


@query("SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '" + html.HREF.replace("'", "''") + "', 1) AS l FROM pages)")
def h2_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", html.hrefs(F.col("html")).alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query()
def h2_resolved_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.resolved(F.col("url"), html.hrefs(F.col("html"))), " ").alias("links"))


# --- filters
@query("SELECT doc_id FROM documents WHERE length(text) >= 200")
def f1_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 200).select("doc_id")


@query(f"SELECT doc_id, length({_sub('text', f'[^{ALPHA}]')}) / greatest(length(text), 1) AS alpha_share FROM documents")
def f2_alpha_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.alpha_share(F.col("text")).alias("alpha_share"))


_UNIQUE = f"len(list_distinct({_words('text')})) / greatest(len({_words('text')}), 1)"
_LINES = "len(string_split(text, chr(10)))"
_RULES = {
    "chars": "length(text) >= 100",
    "words": f"len({_words('text')}) >= 20",
    "unique": f"{_UNIQUE} >= 0.3",
    "alpha": f"length({_sub('text', f'[^{ALPHA}{SPACE}]')}) / greatest(length(text), 1) >= 0.6",
    "lines": f"NOT ((length(text) - {_LINES} + 1) / {_LINES} < 20 AND {_LINES} > 10)",
}
_GATE = "CASE " + " ".join(f"WHEN NOT ({r}) THEN '{k}'" for k, r in _RULES.items()) + " ELSE 'kept' END"


@query(f"SELECT doc_id, {_GATE} AS gate FROM documents")
def f3_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.first_failure(gates.quality_rules(F.col("text"))).alias("gate"))


@query(f"SELECT doc_id FROM documents WHERE length(text) >= 200 AND len({_words('text')}) >= 30 AND {_UNIQUE} >= 0.3")
def f4_web_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(gates.web_gate(F.col("text"))).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE coalesce(lower(lang), '') IN ('', 'fr', 'en')")
def f5_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(gates.language_gate(F.col("lang"))).select("doc_id", "lang")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) > 10 AND len(w) <= 200")
def f8_token_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w")).filter(chat.length_gate(F.col("w"), 10, 200)).select("doc_id")


PAIRS_SQL = """SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 3 THEN source END AS instruction, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN ' ' END AS given, CASE WHEN doc_id % 5 = 4 THEN ' ' ELSE text END AS output FROM documents"""


@query(f"SELECT id FROM ({PAIRS_SQL}) WHERE {_strip('coalesce(instruction, {0})'.format(chr(39) * 2))} <> '' AND {_strip('coalesce(output, {0})'.format(chr(39) * 2))} <> ''")
def f9_required(spark, sf_dir):
    return made(spark, sf_dir, PAIRS_SQL).filter(gates.required(F.col("instruction"), F.col("output"))).select("id")


@query("SELECT doc_id FROM documents WHERE length(text) > 40 AND length(text) < 400")
def f10_candidate_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(gates.length_between(F.col("text"), 40, 400)).select("doc_id")


SUMS_SQL = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN concat(doc_id, ' + (2.5*', n_chars, ')') WHEN 1 THEN text WHEN 2 THEN '' ELSE concat(n_chars, ' % 7') END AS e FROM documents"


@query(rf"SELECT id, regexp_matches(e, '^[0-9+\-*/.()% ]*$') AS ok FROM ({SUMS_SQL})")
def f11_arithmetic(spark, sf_dir):
    return made(spark, sf_dir, SUMS_SQL).select("id", gates.arithmetic_only(F.col("e")).alias("ok"))


@query("""WITH r AS (SELECT text AS f FROM benchmark ORDER BY item_id DESC LIMIT 50), n AS (SELECT * FROM (VALUES (' pas '), (' non '), (' jamais '), (' aucun '), (' false '), (' not ')) t(x))
SELECT doc_id, EXISTS (SELECT 1 FROM n WHERE contains(lower(text), x)) AND EXISTS (SELECT 1 FROM r WHERE contains(text, substr(f, 1, 40)) OR contains(f, substr(text, 1, 40))) AS is_contradicted FROM documents""")  # fmt: skip
def f12_contradicted(spark, sf_dir):
    facts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("fact"))
    return recall.contradicted(facts, table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("fact"))).select("doc_id", "is_contradicted")


_NEXT = f"SELECT doc_id, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
_TRI = f"SELECT doc_id, x || ' ' || y || ' ' || z AS trigram FROM ({_NEXT}) WHERE z IS NOT NULL"


@query(f"SELECT DISTINCT doc_id FROM ({_TRI}) GROUP BY doc_id, trigram HAVING count(*) > 3")
def f13_loop_docs(spark, sf_dir):
    return metrics.loop_docs(table(spark, sf_dir, "documents"))


# --- deduplication
_KEY = f"md5({_sub('lower(text)', f'[{SPACE}]+', ' ')})"


@query(f"WITH l AS (SELECT doc_id, text, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS n FROM documents WHERE length(text) >= 200) "
       f"SELECT doc_id, CASE WHEN n > 1 THEN 'dup' WHEN length({_sub('text', f'[^{ALPHA}]')}) / length(text) < 0.4 THEN 'bad' ELSE 'kept' END AS gate FROM l UNION ALL SELECT doc_id, 'short' FROM documents WHERE NOT coalesce(length(text) >= 200, false)")  # fmt: skip
def d1_corpus_gates(spark, sf_dir):
    return dedup.corpus_gates(table(spark, sf_dir, "documents")).select("doc_id", "gate")


def _runs(df, position):
    """The lower and the upper half of a table by its position."""
    low, high = df.agg(F.min(position), F.max(position)).first()
    half = F.col(position) < F.lit(None if low is None else (low + high) // 2)
    return df.filter(half), df.filter(~half)


@query(ORACLE["d1_corpus_gates"])
def d1_gates_by_runs(spark, sf_dir):
    """Two runs over halves of the documents, the second against an index of what the first has seen."""
    index = seen.SeenIndex(spark, scratch(spark, "d1"))
    first, second = (seen.gated(half, index, f"run{i}").select("doc_id", "gate") for i, half in enumerate(_runs(table(spark, sf_dir, "documents"), "doc_id")))
    return first.unionByName(second)


@query("SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) = 1 AS is_first FROM pages")
def s6_new_addresses(spark, sf_dir):
    """Addresses that neither this crawl nor the one before it has fetched."""
    index = seen.SeenIndex(spark, scratch(spark, "s6"))
    first, second = (seen.first_seen(half, index, f"crawl{i}", F.col("url").cast("binary"), "page_id").select("page_id", "url", "is_first") for i, half in enumerate(_runs(table(spark, sf_dir, "pages"), "page_id")))
    return first.unionByName(second)


@query(f"SELECT gate, count(*) AS n_docs FROM ({ORACLE['d1_corpus_gates']}) GROUP BY gate")
def a1_audit(spark, sf_dir):
    return gates.audit(d1_corpus_gates(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(substr(text, 1, 500)) ORDER BY doc_id) = 1 AS is_first FROM documents")
def d2_prefix_dedup(spark, sf_dir):
    return dedup.first_wins(table(spark, sf_dir, "documents"), dedup.prefix_key(F.col("text")), "doc_id").select("doc_id", "is_first")


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def d3_url_dedup(spark, sf_dir):
    return dedup.first_by_key(table(spark, sf_dir, "pages"), "url", "page_id")


@query("SELECT fact, min(pos) AS pos FROM (" + FACTS_SQL + ") GROUP BY fact")
def d4_fact_dedup(spark, sf_dir):
    return dedup.first_by_key(made(spark, sf_dir, FACTS_SQL), "fact", "pos")


@query(f"""WITH k AS (SELECT DISTINCT list_distinct({_words('lower(text)')}) AS w FROM documents), c AS (SELECT item_id, list_distinct({_words('lower(text)')}) AS w FROM benchmark)
SELECT item_id, len(c.w) >= 3 AND EXISTS (SELECT 1 FROM k WHERE len(list_intersect(c.w, k.w)) >= 0.5 * len(c.w)) AS is_known FROM c""")  # fmt: skip
def d5_known_facts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("fact"))
    return dedup.contained(items, table(spark, sf_dir, "documents"), "fact", "text").select("item_id", "is_known")


@query()
def d5_learned_facts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("fact"))
    return dedup.learned(said, "fact", "pos").select("pos", "is_learned")


@query(f"""WITH t AS (SELECT pos, trim(fact) AS topic FROM ({FACTS_SQL}) WHERE length(trim(fact)) >= 5), k AS (SELECT pos, topic, substr(lower(topic), 1, 80) AS key FROM t),
f AS (SELECT min(pos) AS pos, arg_min(topic, pos) AS topic FROM k WHERE key NOT IN (SELECT lower(text) FROM benchmark) GROUP BY key) SELECT pos, topic FROM f ORDER BY pos LIMIT 80""")  # fmt: skip
def d7_enqueue(spark, sf_dir):
    """Old topics are known by their whole text, new ones by 80 characters: a long one enters again."""
    return dedup.enqueued(made(spark, sf_dir, FACTS_SQL).select("pos", F.col("fact").alias("topic")), table(spark, sf_dir, "benchmark").select("text"))


@query()
def d7_learning_loop(spark, sf_dir):
    """Documents as pages read by their sources, a minute apart; they arrive in three parts, and each part restarts the loop from its checkpoint."""
    at, docs = scratch(spark, "d7"), table(spark, sf_dir, "documents").filter("doc_id is not null")
    pages = docs.select(F.col("source").alias("learner"), F.col("doc_id").alias("pos"), F.timestamp_seconds(F.lit(86_400) + F.col("doc_id") * 60).alias("at"), loop.sentences(F.col("text")).alias("topics"))
    low, high = pages.agg(F.min("pos"), F.max("pos")).first()
    parts = pages.withColumn("part", F.floor((F.col("pos") - F.lit(low)) * 3 / (F.lit(high) - F.lit(low) + 1)))
    for i in range(3):
        parts.filter(F.col("part") == i).drop("part").write.parquet(f"{at}/in/part={i}")
        steps = loop.learning(spark.readStream.schema(loop.PAGE).parquet(f"{at}/in/*"))
        loop.started(spark, steps, f"{at}/out", f"{at}/checkpoint", partitions=8).awaitTermination()
    return spark.read.schema(loop.STEP).parquet(f"{at}/out")


# --- mixing
_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCES.items()) + " END"
_ARRIVAL = f"SELECT *, sum(-ln((('0x' || substr(md5('42|' || source || '|' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / w) OVER (PARTITION BY source ORDER BY doc_id) AS arrival FROM (SELECT *, CAST({_WEIGHT} AS DOUBLE) AS w FROM documents) WHERE w > 0"


@query(f"SELECT doc_id, source, round(arrival, 6) AS arrival FROM ({_ARRIVAL})")
def m1_arrivals(spark, sf_dir):
    return mix.arrivals(table(spark, sf_dir, "documents"), SOURCES).select("doc_id", "source", F.round("arrival", 6).alias("arrival"))


def _mixed_sql(quality=True, dedup=True, chars=400_000):
    kept = f"{_GATE} = 'kept'" if quality else "true"
    first = "row_number() OVER (PARTITION BY md5(substr(text, 1, 500)) ORDER BY arrival, source, doc_id)" if dedup else "1"
    return f"""WITH a AS ({_ARRIVAL}), d AS (SELECT *, {first} AS n FROM a WHERE length(text) >= 50 AND {kept}),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY arrival, source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE n = 1) SELECT doc_id, source FROM b WHERE before < {chars}"""


@query(_mixed_sql())
def m1_mixed_stream(spark, sf_dir):
    return mix.mixed_stream(table(spark, sf_dir, "documents"), SOURCES, max_chars=400_000).drop("arrival")


@query(_mixed_sql(quality=False))
def m4_without_quality(spark, sf_dir):
    return mix.mixed_stream(table(spark, sf_dir, "documents"), SOURCES, quality=False, max_chars=400_000).drop("arrival")


@query(_mixed_sql(dedup=False))
def m4_without_dedup(spark, sf_dir):
    return mix.mixed_stream(table(spark, sf_dir, "documents"), SOURCES, dedup=False, max_chars=400_000).drop("arrival")


@query(f"SELECT doc_id, substr(t, 1, 8000) AS text FROM (SELECT doc_id, {_strip('text')} AS t FROM documents) WHERE length(t) > 200 ORDER BY doc_id LIMIT 50000")
def m5_web(spark, sf_dir):
    return shapes.web(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 200000")
def m2_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return mix.within_budget(d, F.col("n"), 200_000, ["doc_id"]).select("doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE (source = 'src0' AND n <= 30) OR (source = 'src1' AND n <= 15) OR (source = 'src2' AND n <= 5)")
def m3_quota(spark, sf_dir):
    return mix.head_of_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), mix.quota_sizes(50, {"src0": 0.6, "src1": 0.3, "src2": 0.1}))


_SHARES = {"src0": 0.5, "src1": 0.25, "src2": 0.15, "src3": 0.1}
_QUOTAS = " UNION ALL ".join(f"(SELECT source, doc_id, substr(text, 1, 2000) AS text FROM documents WHERE source = '{s}' ORDER BY doc_id LIMIT {max(1, int(200 * n))})" for s, n in _SHARES.items())


@query(f"SELECT *, row_number() OVER (ORDER BY md5('42|' || source || '|' || doc_id)) AS place FROM ({_QUOTAS}) QUALIFY place <= 200")
def m3_in_proportion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix.in_proportion({s: docs.filter(F.col("source") == s) for s in _SHARES}, _SHARES, 200)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src4', 'src5') ORDER BY CASE source WHEN 'src4' THEN 0 WHEN 'src3' THEN 1 ELSE 2 END, doc_id LIMIT 70")
def m3_deficit_fill(spark, sf_dir):
    return mix.filled_quota(table(spark, sf_dir, "documents").select("doc_id", "source"), 70, {"src4": 0, "src3": 1, "src5": 2})


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(t, CAST(i * 4000 + 1 AS BIGINT), 4000) AS chunk FROM (SELECT doc_id, t, unnest(range(0, CAST(floor((length(t) - 1) / 4000) AS BIGINT) + 1)) AS i FROM "
       f"(SELECT doc_id, {_strip('text')} AS t FROM documents) WHERE length(t) >= 300) WHERE length(substr(t, CAST(i * 4000 + 1 AS BIGINT), 4000)) > 200")  # fmt: skip
def m6_chunks(spark, sf_dir):
    return mix.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, chunk_no, chunk AS text FROM (" + ORACLE["m6_chunks"] + ")")
def s8_books(spark, sf_dir):
    """Books whose text is under either of two names."""
    d = made(spark, sf_dir, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS text, CASE WHEN doc_id % 2 = 1 THEN text END AS content FROM documents")
    return shapes.books(d).select("doc_id", "chunk_no", "text")


@query("SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def m7_source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, b >= CAST(floor(t * 0.95) AS BIGINT) AS is_val FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n_chars) OVER () AS t FROM documents)")
def m8_split(spark, sf_dir):
    return mix.after_share(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 0.95, ["doc_id"]).select("doc_id", "is_val")


# --- chat
def _rendered(role, where):
    line = _SAID.format(role=role, text=_strip("text"))
    return f"SELECT c.conv_id, coalesce(t, '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, string_agg({line}, '' ORDER BY turn, role, text) AS t FROM conversations WHERE {_strip('text')} <> '' AND {where} GROUP BY conv_id) USING (conv_id)"


@query(_rendered("lower(role)", "lower(role) IN ('user', 'assistant')"))
def c1_render(spark, sf_dir):
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("turns")).alias("text"))


@query("SELECT * FROM (" + _rendered("CASE WHEN role = 'human' THEN 'user' ELSE 'assistant' END", "true") + ") WHERE length(text) > 100")
def c2_shared_chats(spark, sf_dir):
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", chat.render_two_sided(F.col("turns")).alias("text")).filter(F.length("text") > 100)


_TRIMMED = "SELECT id, " + ", ".join(_strip(f"coalesce({c}, '')") + f" AS {c}" for c in ("instruction", "given", "output")) + f" FROM ({PAIRS_SQL})"


@query(f"SELECT id, CASE WHEN instruction <> '' AND output <> '' THEN '<|user|>' || chr(10) || instruction || CASE WHEN given <> '' THEN chr(10) || given ELSE '' END || chr(10) || '<|assistant|>' || chr(10) || output || chr(10) END AS text FROM ({_TRIMMED})")
def c3_instructions(spark, sf_dir):
    return made(spark, sf_dir, PAIRS_SQL).select("id", chat.instruction(F.col("instruction"), F.col("given"), F.col("output")).alias("text"))


@query("SELECT conv_id, (list(text ORDER BY turn, text) FILTER (WHERE role = 'assistant'))[1] AS answer FROM conversations GROUP BY conv_id")
def c4_first_answer(spark, sf_dir):
    said = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", chat.first_answer(F.struct(said.alias("text"))).alias("answer"))


@query(f"SELECT id, '```' || chr(10) || output || chr(10) || '```' AS text FROM ({PAIRS_SQL})")
def c5_fenced_code(spark, sf_dir):
    return made(spark, sf_dir, PAIRS_SQL).select("id", chat.fenced(F.col("output")).alias("text"))


_OPENINGS = """WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, texts, turns, unnest(range(1, len(texts) + 1)) AS i FROM c)
SELECT md5(array_to_string(texts[:i], chr(1))) AS message_id, CASE WHEN max(i) > 1 THEN md5(array_to_string(first(texts[:i - 1]), chr(1))) END AS parent_id, min(conv_id * 1000 + turns[i]) AS arrival, CASE WHEN bool_or(i = len(texts)) THEN 'assistant' ELSE 'prompter' END AS role, trim(first(texts[i]), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM p GROUP BY 1"""


@query(f"""WITH RECURSIVE m AS (SELECT * FROM ({_OPENINGS}) WHERE length(text) >= 20), k AS (SELECT k.*, row_number() OVER (PARTITION BY k.parent_id ORDER BY k.arrival) AS n FROM m k JOIN m p ON p.message_id = k.parent_id WHERE k.arrival > p.arrival),
t AS (SELECT message_id, 'open' AS role, concat('<|user|>', chr(10), text, chr(10)) AS "full" FROM m WHERE parent_id IS NULL UNION ALL SELECT k.message_id, CASE WHEN k.role = 'prompter' THEN 'open' ELSE k.role END, concat(t."full", CASE WHEN k.role = 'assistant' THEN '<|assistant|>' ELSE '<|user|>' END, chr(10), k.text, chr(10))
FROM t JOIN k ON k.parent_id = t.message_id AND k.n = 1 WHERE t.role = 'open') SELECT message_id, substr("full", 1, 2000) AS "full" FROM t WHERE role = 'assistant' AND length("full") > 100""")  # fmt: skip
def c6_message_tree(spark, sf_dir):
    """Conversations as a tree: equal openings are one message, the last turn of a conversation closes it."""
    c = chat.turns(table(spark, sf_dir, "conversations")).withColumn("texts", F.transform("turns", lambda t: t["text"]))
    opening = lambda n: F.md5(F.array_join(F.slice("texts", F.lit(1), n), "\x01").cast("binary"))
    p = c.select("conv_id", "texts", F.posexplode("turns").alias("at", "t"))
    p = p.select(opening(F.col("at") + 1).alias("message_id"), F.when(F.col("at") > 0, opening(F.col("at"))).alias("parent_id"), (F.col("conv_id") * 1000 + F.col("t.turn")).alias("arrival"), (F.col("at") + 1 == F.size("texts")).alias("last"), F.col("t.text").alias("text"))
    m = p.groupBy("message_id").agg(F.min("parent_id").alias("parent_id"), F.min("arrival").alias("arrival"), F.when(F.bool_or("last"), "assistant").otherwise("prompter").alias("role"), F.min("text").alias("text"))
    return chat.tree_pairs(m.withColumn("lang", F.lit(None).cast("string")))


_ROLE_IDS = "list_concat([CASE WHEN role = 'user' THEN 261 ELSE 262 END], list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INTEGER)))"


@query(f"SELECT conv_id, array_to_string(list_concat([258], list_concat(flatten(list({_ROLE_IDS} ORDER BY turn)), [259])), ' ') AS ids FROM conversations GROUP BY conv_id")
def c7_training_ids(spark, sf_dir):
    msgs = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.transform(F.split(t["text"], " "), lambda x: F.length(x)).alias("ids")))
    return chat.turns(table(spark, sf_dir, "conversations")).select("conv_id", F.array_join(chat.training_ids(msgs), " ").alias("ids"))


@query("""WITH t AS (SELECT conv_id, list(CAST(length(text) AS INTEGER) ORDER BY turn) AS ids, CAST(floor((row_number() OVER (ORDER BY conv_id) - 1) / 8) AS BIGINT) AS batch_id FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, batch_id, ids[:-2] AS x, ids[2:] AS y, max(len(ids) - 1) OVER (PARTITION BY batch_id) AS n FROM t)
SELECT conv_id, batch_id, array_to_string(list_concat(x, list_transform(range(n - len(x)), lambda i: 256)), ' ') AS x, array_to_string(list_concat(y, list_transform(range(n - len(y)), lambda i: -1)), ' ') AS y FROM s""")  # fmt: skip
def c8_padded_batches(spark, sf_dir):
    c = chat.turns(table(spark, sf_dir, "conversations")).withColumn("ids", F.transform("turns", lambda t: F.length(t["text"])))
    x, y = chat.shifted(F.col("ids"))
    b = chat.padded_batches(c.select("conv_id", x.alias("x"), y.alias("y")), "x", "y", 8, "conv_id")
    return b.select("conv_id", "batch_id", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


#: A document as tokens of four characters, of which up to all are a prompt; every fourth has none.
_FOURS = "SELECT doc_id, CAST(floor(length(text) / 4) AS INT) AS n, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(floor(length(text) * (doc_id % 5) / 4) AS INT) END AS prompt FROM documents WHERE text IS NOT NULL"
_TARGET = "CASE WHEN prompt > 0 AND n >= 3 AND 4 * (n - 1) >= prompt AND i >= 1 AND 4 * i < prompt THEN -1 ELSE i * 7 + doc_id END"


@query(f"SELECT doc_id, array_to_string([{_TARGET} FOR i IN range(n)], ' ') AS targets FROM ({_FOURS})")
def c9_continuation_targets(spark, sf_dir):
    at = made(spark, sf_dir, _FOURS).withColumn("i", F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")))
    ids, starts = F.transform("i", lambda i: i * 7 + F.col("doc_id")), F.transform("i", lambda i: i * 4)
    t = at.select("doc_id", "prompt", ids.alias("ids"), starts.alias("starts"))
    return t.select("doc_id", F.array_join(chat.continuation_targets(F.col("ids"), F.col("starts"), F.col("prompt")), " ").alias("targets"))


@query(f"""WITH m AS (SELECT conv_id % 9 AS modified, conv_id * 1000 + turn AS position, {_strip('text')} AS topic FROM conversations WHERE role = 'user'), n AS (SELECT DISTINCT conv_id % 9 AS modified FROM conversations ORDER BY 1 DESC LIMIT 5),
f AS (SELECT substr(topic, 1, 150) AS topic, min((-modified, position)) AS a FROM m JOIN n USING (modified) WHERE length(topic) > 20 AND length(topic) < 200 GROUP BY 1) SELECT topic FROM f ORDER BY a LIMIT 30""")  # fmt: skip
def c10_recent_interests(spark, sf_dir):
    rows = made(spark, sf_dir, "SELECT conv_id % 9 AS modified, conv_id * 1000 + turn AS position, role, text FROM conversations")
    return chat.recent_interests(rows)


@query("SELECT count(DISTINCT conv_id) AS n_conversations, count(*) AS n_messages FROM conversations")
def c11_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"))


# --- tokens
_PRE = f"regexp_extract_all(text, '{tokens.SPLIT.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT doc_id, len({_PRE}) AS n_words, length(text) - length(array_to_string({_PRE}, '')) AS n_dropped FROM documents")
def t1_pretokens(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", "text", tokens.pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_words"), (F.length("text") - F.length(F.array_join("p", ""))).cast("long").alias("n_dropped"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_PRE}) AS word FROM documents) GROUP BY word")
def t2_word_counts(spark, sf_dir):
    return tokens.word_counts(table(spark, sf_dir, "documents"))


_TRAINED = {}


def _merges(spark, sf_dir):
    """The merges of all documents' words, trained once for the same word counts."""
    counts = saved(tokens.word_counts(table(spark, sf_dir, "documents")))
    h = F.xxhash64("word", "n")
    key = tuple(counts.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())
    if key not in _TRAINED:
        _TRAINED[key] = training.train(counts)
    return _TRAINED[key]


@query()
def t3_merges(spark, sf_dir):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_merges(spark, sf_dir))], "rank int, left_id int, right_id int")


@query()
def t4_encode(spark, sf_dir):
    encode = tokens.encoder(_merges(spark, sf_dir), ends=True)
    return table(spark, sf_dir, "documents").select("doc_id", encode(tokens.pretokens(F.col("text"))).alias("ids"))


@query(f"SELECT doc_id, array_to_string({_PRE}, '') AS text FROM documents")
def t5_round_trip(spark, sf_dir):
    merges = _merges(spark, sf_dir)
    ids = tokens.encoder(merges, ends=True)(tokens.pretokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.decoder(merges)(ids).alias("text"))


_LENGTHS = f"SELECT doc_id, list_transform({_PRE}, lambda x: CAST(length(x) AS INTEGER)) AS ids FROM documents"


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(tokens.pretokens(F.col("text")), lambda x: F.length(x)).alias("ids"))


@query(f"SELECT doc_id, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_LENGTHS})")
def t6_offsets(spark, sf_dir):
    return tokens.offsets(_lengths(spark, sf_dir)).select("doc_id", F.col("offset").cast("long").alias("offset"))


_STREAM = f"SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM ({_LENGTHS}))"


@query(f"SELECT CAST(floor(pos / 129) AS BIGINT) AS seq_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM ({_STREAM}) GROUP BY 1 HAVING count(*) = 129")
def p1_windows(spark, sf_dir):
    return tokens.packed(_lengths(spark, sf_dir), 128).select("seq_id", F.array_join("ids", " ").alias("ids"))


@query(f"WITH s AS ({_STREAM}), w AS (SELECT id, pos, CAST(floor(pos / 128) AS BIGINT) AS seq_id FROM s UNION ALL SELECT id, pos, CAST(pos / 128 - 1 AS BIGINT) FROM s WHERE pos % 128 = 0 AND pos > 0) SELECT seq_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM w GROUP BY 1 HAVING count(*) = 129")
def p2_overlapping_windows(spark, sf_dir):
    return tokens.packed(_lengths(spark, sf_dir), 128, overlap=True).select("seq_id", F.array_join("ids", " ").alias("ids"))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM ({_LENGTHS})")
def p3_stats(spark, sf_dir):
    return tokens.stats(_lengths(spark, sf_dir))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, 32000 AS vocab_size FROM ({_LENGTHS})")
def k4_tokens(spark, sf_dir):
    return writers.tokens(_lengths(spark, sf_dir), scratch(spark, "k4"), 32_000)


@query(ORACLE["p1_windows"])
def s12_flat_tokens(spark, sf_dir):
    """Written as flat files in the order of documents and read back by ranges of bytes."""
    spark.dataSource.register(FlatTokens)
    at, ids = scratch(spark, "s12"), _lengths(spark, sf_dir)
    ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("ids").write.format("flat_tokens").mode("append").save(at)
    return spark.read.format("flat_tokens").option("length", 129).load(at).select("seq_id", F.array_join("ids", " ").alias("ids"))


@query(ORACLE["p2_overlapping_windows"])
def k5_sequences(spark, sf_dir):
    at = scratch(spark, "k5")
    writers.sequences(_lengths(spark, sf_dir), at, 128)
    return spark.read.schema("seq_id bigint, ids array<int>").json(at).select("seq_id", F.array_join("ids", " ").alias("ids"))


@query()
def p2_prepared(spark, sf_dir):
    """Documents by our tokenizer, all but the last of those that are long enough."""
    docs = table(spark, sf_dir, "documents")
    most = docs.filter(F.length("text") >= 50).count() - 1
    return tokens.prepared(docs, tokens.encoder(_merges(spark, sf_dir)), 128, max_docs=most)


@query()
def k6_tokenizer(spark, sf_dir):
    at = scratch(spark, "k6")
    writers.tokenizer(spark, at, _merges(spark, sf_dir))
    saved = spark.read.schema("merges array<array<int>>").json(at)
    return saved.select(F.posexplode("merges").alias("rank", "pair")).select("rank", F.get("pair", F.lit(0)).alias("left_id"), F.get("pair", F.lit(1)).alias("right_id"))


# --- metrics
@query(f"WITH c AS (SELECT trigram, count(*) AS n FROM ({_TRI}) GROUP BY trigram) SELECT count(*) / sum(n) AS diversity, count(*) AS unique_trigrams, CAST(sum(n) AS BIGINT) AS total_trigrams, (SELECT count(*) FROM ({ORACLE['f13_loop_docs']})) AS loop_docs FROM c")
def a3_diversity(spark, sf_dir):
    return metrics.diversity(table(spark, sf_dir, "documents"))


@query("SELECT round(exp(sum(value / 100 * (event_id % 7)) / sum(event_id % 7)), 6) AS perplexity FROM events")
def a4_perplexity(spark, sf_dir):
    rows = made(spark, sf_dir, "SELECT value / 100 AS loss, event_id % 7 AS n_tokens FROM events")
    return metrics.perplexity(rows).select(F.round("perplexity", 6).alias("perplexity"))


@query("""WITH r AS (SELECT event_id % 2 AS run, avg(value) AS mean_value, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), l AS (SELECT run, 'mean_value' AS measure, mean_value AS v FROM r UNION ALL SELECT run, 'n', n FROM r)
SELECT a.measure, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS delta FROM l a JOIN l b USING (measure) WHERE a.run = 0 AND b.run = 1""")  # fmt: skip
def a5_compared(spark, sf_dir):
    run = lambda i: made(spark, sf_dir, f"SELECT avg(value) AS mean_value, count(*) AS n FROM events WHERE event_id % 2 = {i}")
    return metrics.compared(run(0), run(1), ["mean_value", "n"]).select("measure", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")])


@query("""WITH r AS (SELECT event_type AS log, event_id AS pos, value AS loss, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS u FROM events),
g AS (SELECT log, count(*) AS entries, max(pos) AS last_step, arg_max(loss, pos) AS last_loss, avg(loss) FILTER (n > 10 AND u <= 10) AS e, avg(loss) FILTER (n > 10 AND u > n - 10) AS r FROM r GROUP BY log)
SELECT log, entries, last_step, last_loss, round(e, 6) AS early_loss, round(r, 6) AS recent_loss, round(e - r, 6) AS "drop" FROM g""")  # fmt: skip
def a6_log_summary(spark, sf_dir):
    log = made(spark, sf_dir, "SELECT event_type AS log, event_id AS pos, event_id AS step, value AS loss FROM events")
    s = metrics.log_summary(log)
    return s.select("log", "entries", "last_step", "last_loss", *[F.round(c, 6).alias(c) for c in ("early_loss", "recent_loss", "drop")])


@query("SELECT CAST(floor(event_id / 100) AS BIGINT) AS interval, round(avg(value), 6) AS mean_loss, max(event_id) AS last_step FROM events GROUP BY 1")
def a7_interval_means(spark, sf_dir):
    log = made(spark, sf_dir, "SELECT event_id AS step, value AS loss FROM events")
    return metrics.interval_means(log, 100).select("interval", F.round("mean_loss", 6).alias("mean_loss"), "last_step")


@query("SELECT epoch, step, mean_loss FROM (SELECT user_id AS epoch, event_id AS step, round(avg(value) OVER w, 6) AS mean_loss, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE n % 10 = 0")
def a7_epoch_means(spark, sf_dir):
    log = made(spark, sf_dir, "SELECT user_id AS epoch, event_id AS step, value AS loss FROM events")
    return metrics.epoch_means(log).select("epoch", "step", F.round("mean_loss", 6).alias("mean_loss"))


@query()
def a8_inventory(spark, sf_dir):
    files = spark.read.format("binaryFile").load(f"{sf_dir}/*.parquet").select("path", "length")
    return metrics.file_inventory(files).select("n_files", "n_bytes")


@query("SELECT count(*) AS n_facts, count(DISTINCT fact) AS n_distinct FROM (" + FACTS_SQL + ")")
def a9_memory_stats(spark, sf_dir):
    return made(spark, sf_dir, FACTS_SQL).agg(F.count("*").alias("n_facts"), F.countDistinct("fact").alias("n_distinct"))


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 10")
def a10_last(spark, sf_dir):
    return metrics.last(table(spark, sf_dir, "events").select("event_id", "value"), 10, "event_id")


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 3e-4 * (event_id + 1) / 100 WHEN event_id >= 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * (event_id - 100) / 900)) END, 12) AS lr FROM events")
def w1_learning_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(metrics.learning_rate(F.col("event_id"), 100, 1000, 3e-4, 3e-5), 12).alias("lr"))


SHAPES_SQL = "SELECT p_partkey, 32000 + p_partkey % 100 AS vocab, 768 AS d, p_size AS layers, 12 AS heads, 4 AS kv, 2048 + p_partkey % 7 AS ff FROM part"


@query(f"SELECT p_partkey, CAST(vocab * d + layers * ((heads + 2 * kv) * (d // heads) * d + d * d) + layers * 3 * d * ff AS BIGINT) AS n FROM ({SHAPES_SQL})")
def w2_parameters(spark, sf_dir):
    return made(spark, sf_dir, SHAPES_SQL).select("p_partkey", metrics.parameters(*[F.col(c).cast("long") for c in ("vocab", "d", "layers", "heads", "kv", "ff")]).cast("long").alias("n"))


# --- retrieval and parsing
_ASKED = "the heated tion of the"
_SCORE = f"CASE WHEN contains(lower(fact), '{_ASKED}') THEN 1.0 ELSE len(list_intersect(list_distinct({_words(chr(39) + _ASKED + chr(39))}), {_words('lower(fact)')})) / 4.0 END"


@query(f"SELECT pos, fact, CAST(score AS DOUBLE) AS score FROM (SELECT *, {_SCORE} AS score FROM ({FACTS_SQL})) WHERE score > 0 ORDER BY score DESC, pos LIMIT 5")
def r1_search_facts(spark, sf_dir):
    return recall.search(made(spark, sf_dir, FACTS_SQL), _ASKED)


@query(f"SELECT 'Préférences: {{{{\"langue\": \"fr\", \"ton\": \"bref\"}}}}' || chr(10) || 'Faits connus:' || chr(10) || string_agg('- ' || fact, chr(10) ORDER BY score DESC, pos) AS context FROM (SELECT *, {_SCORE} AS score FROM ({FACTS_SQL}) WHERE {_SCORE} > 0 ORDER BY score DESC, pos LIMIT 10)".replace("{{", "{").replace("}}", "}"))
def r2_context(spark, sf_dir):
    prefs = spark.sql("SELECT * FROM (VALUES ('langue', 'fr'), ('ton', 'bref')) t(key, value)")
    return recall.context(made(spark, sf_dir, FACTS_SQL), prefs, _ASKED)


TURNS_SQL = "SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"
FRAGMENTS_SQL = "SELECT item_id AS query_id, substring(text, 3, 4 + CAST(item_id % 12 AS INT)) AS query FROM benchmark"


def _best_sql(queries, facts, k):
    """Every query against every fact."""
    share = "len(list_intersect(q.have, f.w)) / len(q.have)"
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, pos, fact, score FROM (SELECT query_id, pos, fact, CASE WHEN contains(low, asked) THEN 1.0 ELSE {share} END AS score
FROM (SELECT query_id, lower(query) AS asked, list_distinct({_words('lower(query)')}) AS have FROM ({queries})) q, (SELECT pos, fact, lower(fact) AS low, {_words('lower(fact)')} AS w FROM ({facts})) f
WHERE len(have) > 0) WHERE score > 0 QUALIFY rank <= {k}"""


@query(f"SELECT query_id, rank, pos, CAST(score AS DOUBLE) AS score FROM ({_best_sql(TURNS_SQL, FACTS_SQL, 5)})")
def r1_search_turns(spark, sf_dir):
    """Every turn of a user against all documents."""
    return lookup.search_all(made(spark, sf_dir, FACTS_SQL), made(spark, sf_dir, TURNS_SQL))


@query(f"SELECT query_id, rank, pos, CAST(score AS DOUBLE) AS score FROM ({_best_sql(FRAGMENTS_SQL, FACTS_SQL, 5)})")
def r1_search_fragments(spark, sf_dir):
    """Pieces of texts that begin and end inside words."""
    return lookup.search_all(made(spark, sf_dir, FACTS_SQL), made(spark, sf_dir, FRAGMENTS_SQL))


BENCH_SQL = "SELECT item_id AS pos, text AS fact FROM benchmark"


@query(f"""SELECT query_id, '{PREFERENCES}{{"langue": "fr", "ton": "bref"}}' || coalesce(chr(10) || '{FACTS}' || chr(10) || string_agg('- ' || fact, chr(10) ORDER BY rank), '') AS context
FROM ({TURNS_SQL}) LEFT JOIN ({_best_sql(TURNS_SQL, BENCH_SQL, 10)}) USING (query_id) GROUP BY query_id""")
def r2_contexts(spark, sf_dir):
    """What the prompt of each turn is told of the benchmark's texts."""
    prefs = spark.sql("SELECT * FROM (VALUES ('langue', 'fr'), ('ton', 'bref')) t(key, value)")
    return lookup.contexts(made(spark, sf_dir, BENCH_SQL), made(spark, sf_dir, TURNS_SQL), prefs)


#: A queue is 80 topics at most.
QUEUE_SQL = "SELECT item_id AS pos, text AS topic FROM benchmark ORDER BY item_id LIMIT 80"


@query(f"""WITH q AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM ({QUEUE_SQL})), s AS (SELECT coalesce(min(i), 0) AS start FROM q WHERE i < 15 AND (contains(lower(topic), 'ou') OR contains('ou', lower(topic))))
SELECT pos, topic, (i - start + n) % n AS new_pos FROM q, s""")
def r3_prioritised(spark, sf_dir):
    return recall.prioritised(made(spark, sf_dir, QUEUE_SQL), "Ou")


@query(r"SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in recall.SEARCH) + r" THEN 'search_web' WHEN regexp_matches(text, '[-+*/]') AND regexp_matches(text, '\p{Nd}') THEN 'calculator' WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in recall.DATE) + " THEN 'get_datetime' ELSE 'none' END AS tool FROM conversations")
def r4_route(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", recall.route(F.col("text")).alias("tool"))


_NAMES_SQL = "SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'distill_s' WHEN 1 THEN 'step_' ELSE 'distill_sx' END, event_id, '.pt') AS name FROM events"


@query(f"SELECT name, event_id AS step FROM ({_NAMES_SQL}) WHERE event_id % 3 = 0 ORDER BY event_id DESC LIMIT 1")
def r5_resume_point(spark, sf_dir):
    return parse.resume_point(made(spark, sf_dir, _NAMES_SQL).select("name"))


REPLIES_SQL = f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat('FAITS:', chr(10), '- ', {SAFE}, ' [CAT:', coalesce(lang, '?'), ']', chr(10), '- court', chr(10), '2) deuxieme fait assez long de ', coalesce(source, '?'),
chr(10), 'SUJETS:', chr(10), '* la formation de ', coalesce(source, '?'), chr(10), 'bavardage') WHEN 1 THEN text ELSE source END AS raw FROM documents"""
_LONG_LINES = f"SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 3 = 1 AND length(text) > 50"


_BARE = _strip(_sub(_strip("line"), "^[-*]+"))
_FACT = _strip(_sub(_strip(SAFE), rf"^[-*\p{{Nd}}).{SPACE}]+"))


@query(f"""WITH f AS (SELECT doc_id AS id, {_FACT} AS a, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source FROM documents WHERE doc_id % 3 = 0), g AS (SELECT *, a <> '' AND length(a) + length(lang) + 7 >= 15 AS long FROM f),
l AS (SELECT id, {_BARE} AS content, i FROM ({_LONG_LINES}))
SELECT id, 'fact' AS kind, 1 AS n, a AS content, lang AS category FROM g WHERE long UNION ALL SELECT id, 'fact', CASE WHEN long THEN 2 ELSE 1 END, 'deuxieme fait assez long de ' || source, NULL FROM g
UNION ALL SELECT id, 'topic', 1, 'la formation de ' || source, NULL FROM g
UNION ALL SELECT id, 'fact', row_number() OVER (PARTITION BY id ORDER BY i) AS n, content, NULL FROM l WHERE length(content) > 40 AND length(content) < 400 QUALIFY n <= 12""")
def r6_facts_and_topics(spark, sf_dir):
    """Replies with headings, with long lines alone, and with neither."""
    return parse.facts_and_topics(made(spark, sf_dir, REPLIES_SQL))


CALLS_SQL = f"""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN concat('x <answer> ', coalesce(text, ''), ' </answer>') WHEN 1 THEN concat('<tool> ', coalesce(source, ''), ' </tool><args>{{"query":"', {SAFE}, '"}}</args>')
WHEN 2 THEN concat('<tool>', coalesce(lang, ''), '</tool><args>{{', {SAFE}, '</args>') ELSE text END AS reply FROM documents"""


@query(f"""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN {_strip("coalesce(text, '')")} END AS answer, CASE doc_id % 4 WHEN 1 THEN coalesce(source, '') WHEN 2 THEN coalesce(lang, '') END AS tool,
CASE WHEN doc_id % 4 = 1 THEN {SAFE} END AS query FROM documents""")
def r7_actions(spark, sf_dir):
    a = made(spark, sf_dir, CALLS_SQL).withColumn("a", parse.action(F.col("reply")))
    return a.select("id", "a.answer", "a.tool", F.try_element_at("a.args", F.lit("query")).alias("query"))


@query()
def r8_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", parse.sentences(F.col("text")).alias("sentences"))


STREAM_SQL = f"""SELECT conv_id AS id, turn AS pos, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN '{{"error":"x","response":"y","done":true}}' WHEN conv_id % 5 = 0 AND turn = 0 THEN {SAFE}
WHEN role = 'user' THEN concat('{{"response":" ', {SAFE}, '","done":', CASE WHEN turn >= 2 THEN 'true' ELSE 'false' END, '}}') ELSE concat('{{"message":{{"content":"', {SAFE}, ' "}}}}') END AS line FROM conversations"""


_HEARD = f"""SELECT conv_id, turn, CASE WHEN (conv_id % 3 = 0 AND turn = 1) OR (conv_id % 5 = 0 AND turn = 0) THEN '' WHEN role = 'user' THEN ' ' || {SAFE} ELSE {SAFE} || ' ' END AS said,
min(CASE WHEN role = 'user' AND turn >= 2 THEN turn END) OVER (PARTITION BY conv_id) AS done FROM conversations"""


@query(f"SELECT conv_id AS id, {_strip('said')} AS text FROM (SELECT conv_id, coalesce(string_agg(said, '' ORDER BY turn) FILTER (WHERE done IS NULL OR turn <= done), '') AS said FROM ({_HEARD}) GROUP BY conv_id)")
def r9_streamed_reply(spark, sf_dir):
    """Conversations as streams: a line that reports an error, one that is no object, and an end before the last line."""
    return parse.streamed(made(spark, sf_dir, STREAM_SQL))


REPLY_SQL = f"""SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('{{"response":" ', {SAFE}, ' ","thinking":"b"}}') WHEN 1 THEN concat('{{"response":"","thinking":" ', {SAFE}, '","message":{{"content":"c"}}}}')
WHEN 2 THEN concat('{{"message":{{"content":"', {SAFE}, ' ","thinking":"d"}}}}') WHEN 3 THEN concat('{{"message":{{"content":"","thinking":"', {SAFE}, '"}}}}') WHEN 4 THEN concat('{{"error":"x","response":"', {SAFE}, '"}}') ELSE {SAFE} END AS reply FROM documents"""


_REPLY_TEXT = "CASE id WHEN 0 THEN t WHEN 1 THEN CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '...' ELSE t END WHEN 2 THEN CASE WHEN s = '' THEN 'd' ELSE t END WHEN 3 THEN substr(t, 1, 2000) ELSE '' END"


@query(f"SELECT doc_id AS id, {_REPLY_TEXT.replace('id WHEN', 'doc_id % 6 WHEN')} AS text FROM (SELECT doc_id, {SAFE} AS s, {_strip(SAFE)} AS t FROM documents)")
def r10_reply_text(spark, sf_dir):
    return made(spark, sf_dir, REPLY_SQL).select("id", parse.reply_text(F.col("reply")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 120) || ' [...] ' || right(t, 80) END AS text FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' | ') AS t FROM documents)")
def r11_peek(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.peek(F.col("text")).alias("text"))


# --- two tokenisations of the documents: our trained one, and one by a public vocabulary
THEIRS = os.environ.get("LOOMTEXT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that vocabulary's texts are split into words.
THEIR_SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EDGES = "SELECT l_partkey AS their_id, l_suppkey AS our_id FROM lineitem"


def _two_vocabularies(spark, sf_dir):
    """Our pieces by id, the table of theirs, and functions from a text column to ids of both."""
    merges, theirs = _merges(spark, sf_dir), readers.ranked_pieces(spark, THEIRS)
    ranks = {bytes(r["piece"]): r["id"] for r in theirs.collect()}  # a vocabulary
    ours, encode, rank = tokens.vocabulary(merges), tokens.encoder(merges), tokens.rank_encoder(ranks)
    return ours, theirs, ranks, lambda t: encode(tokens.pretokens(t)), lambda t: rank(F.regexp_extract_all(t, F.lit(THEIR_SPLIT), F.lit(0)))


@query()
def v1_vocab_edges(spark, sf_dir):
    ours, theirs, _, to_ours, to_theirs = _two_vocabularies(spark, sf_dir)
    return vocab.vocab_map(spark.createDataFrame(list(ours.items()), "id int, piece binary"), theirs, to_ours, to_theirs)


@query(f"SELECT their_id, our_id, count(*) / sum(count(*)) OVER (PARTITION BY their_id) AS weight FROM ({_EDGES}) GROUP BY 1, 2")
def v2_edge_weights(spark, sf_dir):
    return vocab.edge_weights(made(spark, sf_dir, _EDGES))


def _aligned(spark, sf_dir):
    ours, _, ranks, to_ours, to_theirs = _two_vocabularies(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", to_ours(F.col("text")).alias("our_ids"), to_theirs(F.col("text")).alias("their_ids"))
    size = [0] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        size[i] = len(piece)
    return vocab.aligned(rows, vocab.text_lengths(ours, range(256, training.BASE)), size)


@query()
def v5_aligned(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query()
def v6_position_map(spark, sf_dir):
    return vocab.position_map(_aligned(spark, sf_dir))


# --- token distributions, over the embeddings as logits
LOGITS_SQL = "SELECT vec_id AS pos, id, CAST(v AS DOUBLE) * 10 AS logit FROM (SELECT vec_id, {0} FROM embeddings) e"
_LOGITS = LOGITS_SQL.format("unnest(embedding) AS v, unnest(range(len(embedding))) AS id")


def _positions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.transform("embedding", lambda v: v.cast("double") * 10).alias("logits"))


def _few_edges(spark):
    """Each of 64 ids has an edge to its half and its third."""
    r = spark.range(64).select(F.col("id").cast("int").alias("their_id"))
    return r.select("their_id", F.explode(F.array(*(F.floor(F.col("their_id") / n).cast("int") for n in (2, 3)))).alias("our_id"))


_W = "SELECT their_id, our_id, sum(w) AS weight FROM (SELECT id AS their_id, our_id, 0.5::DOUBLE AS w FROM (SELECT range AS id, range // 2 AS our_id FROM range(64) UNION ALL SELECT range, range // 3 FROM range(64))) GROUP BY 1, 2"
_P = f"SELECT pos, id, exp(logit - max(logit) OVER (PARTITION BY pos)) / sum(exp(logit - m)) OVER (PARTITION BY pos) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY pos) AS m FROM ({_LOGITS}))"
_PROJECTED = f"SELECT pos, our_id, q / (sum(q) OVER (PARTITION BY pos) + 1e-10) AS p FROM (SELECT pos, our_id, sum(p * weight) AS q FROM ({_P}) JOIN ({_W}) ON id = their_id GROUP BY 1, 2)"


@query(f"SELECT pos, CAST(our_id AS INTEGER) AS our_id, round(ln(p + 1e-10), 6) AS logit FROM ({_PROJECTED})")
def v3_projected_logits(spark, sf_dir):
    out = vocab.projected_logits(_positions(spark, sf_dir), vocab.edge_weights(_few_edges(spark)))
    return out.select("pos", F.inline("logits")).select("pos", F.col("id").alias("our_id"), F.round("logit", 6).alias("logit"))


@query(f"SELECT pos, CAST(our_id AS INTEGER) AS our_id, round(p, 9) AS p FROM ({_PROJECTED})")
def v4_projected(spark, sf_dir):
    p = _positions(spark, sf_dir).select("pos", vocab.softmax(F.col("logits")).alias("p"))
    return vocab.projected(p, vocab.edge_weights(_few_edges(spark))).select("pos", F.inline("p")).select("pos", F.col("id").alias("our_id"), F.round("p", 9).alias("p"))


def _tops(spark, sf_dir, k=10):
    return _positions(spark, sf_dir).select("pos", vocab.top_k(vocab.softmax(F.col("logits")), k).alias("top"))


@query(f"SELECT pos, CAST(id AS INTEGER) AS id, round(p, 9) AS p, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY p DESC, id) AS r FROM ({_P})) WHERE r <= 10")
def v7_top_k(spark, sf_dir):
    return _tops(spark, sf_dir).select("pos", F.posexplode("top").alias("n", "x")).select("pos", "x.id", F.round("x.p", 9).alias("p"), (F.col("n") + 1).alias("rank"))


@query(ORACLE["v7_top_k"].replace(", CAST(r AS INTEGER) AS rank", ""))
def s13_top_logits(spark, sf_dir):
    at = scratch(spark, "s13")
    _tops(spark, sf_dir).write.parquet(at)
    return readers.top_logits(spark, at).withColumn("p", F.round("p", 9))


@query(f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY p DESC, id) AS r FROM ({_P})) WHERE r <= 10), o AS (SELECT pos, greatest(1 - sum(p), 0) / 54 AS other FROM t GROUP BY pos),
f AS (SELECT o.pos, g.range AS id, coalesce(t.p, other) AS p FROM o CROSS JOIN range(64) g LEFT JOIN t ON t.pos = o.pos AND t.id = g.range) SELECT pos, CAST(id AS INTEGER) AS id, round(p / sum(p) OVER (PARTITION BY pos), 9) AS p FROM f""")  # fmt: skip
def v8_rebuilt(spark, sf_dir):
    return _tops(spark, sf_dir).select("pos", F.posexplode(vocab.rebuilt(F.col("top"), 64)).alias("id", "p")).withColumn("p", F.round("p", 9))


_SOFT = "SELECT pos, id, exp({0} - max({0}) OVER w) / sum(exp({0} - m)) OVER w AS p FROM (SELECT *, max({0}) OVER (PARTITION BY pos) AS m FROM ({1})) WINDOW w AS (PARTITION BY pos)"


@query(f"""WITH s AS ({_SOFT.format('x', f'SELECT pos, id, logit / 2 AS x FROM ({_LOGITS})')}), t AS ({_SOFT.format('x', f'SELECT pos, id, -logit / 2 AS x FROM ({_LOGITS})')}), kl AS (SELECT pos, sum(t.p * (ln(t.p) - ln(s.p))) AS kl FROM s JOIN t USING (pos, id) GROUP BY pos),
ce AS (SELECT pos, -ln(p) AS ce FROM ({_P}) WHERE id = pos % 64) SELECT pos, round(0.7 * 4 * kl + 0.3 * ce, 6) AS loss FROM kl JOIN ce USING (pos)""")  # fmt: skip
def v9_distillation_loss(spark, sf_dir):
    teacher, target = F.transform("logits", lambda x: -x), (F.col("pos") % 64).cast("int")
    return _positions(spark, sf_dir).select("pos", F.round(vocab.distillation_loss(F.col("logits"), teacher, target), 6).alias("loss"))


@query(f"""WITH x AS (SELECT pos, id, CASE WHEN id % 5 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.15 ELSE logit * 1.15 END ELSE logit END / 0.7 AS x FROM ({_LOGITS})), k AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY pos ORDER BY x DESC) AS r FROM x) WHERE r <= 50),
p AS ({_SOFT.format('x', 'SELECT pos, id, x FROM k')}), n AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY pos ORDER BY p DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT pos, CAST(id AS INTEGER) AS id, round(p / sum(p) OVER (PARTITION BY pos), 6) AS p FROM n WHERE b < 0.9""")  # fmt: skip
def v10_sampling_filter(spark, sf_dir):
    seen = F.sequence(F.lit(0), F.lit(60), F.lit(5))
    return _positions(spark, sf_dir).select("pos", F.inline(vocab.sampling_filter(F.col("logits"), seen))).withColumn("p", F.round("p", 6))


@query()
def s12_resumed_tokens(spark, sf_dir):
    """Documents encoded by the public vocabulary; a stream of their sequences that stops after 100 and after 250, and is taken up again where it stood."""
    spark.dataSource.register(FlatTokens)
    at, docs = scratch(spark, "s12"), table(spark, sf_dir, "documents")
    rank = tokens.rank_encoder({bytes(r["piece"]): r["id"] for r in readers.ranked_pieces(spark, THEIRS).collect()})  # a vocabulary
    # in order before they are encoded: cutting into ranges samples its rows, and would encode them all twice
    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed.select(rank(F.regexp_extract_all("text", F.lit(THEIR_SPLIT), F.lit(0))).alias("ids")).write.format("flat_tokens").mode("append").save(f"{at}/ids")
    for run, until in enumerate((100, 250, None)):
        stream = spark.readStream.format("flat_tokens").option("length", 65)
        stream = stream.option("until", until) if until else stream
        rows = stream.load(f"{at}/ids").withColumn("run", F.lit(run))
        rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq_id bigint, ids array<int>, run int").parquet(f"{at}/out")
