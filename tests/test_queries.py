"""Every query runs; where it has SQL, DuckDB gives the same rows, else plain Python does."""

import base64
import functools
import json
import os
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from compare import assert_same

from loomtext.plans.queries import ORACLE, QUERIES, THEIR_SPLIT, THEIRS


class Page(HTMLParser):
    """The text outside script, style and nav, and the targets of anchors."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.pieces, self.targets = [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "nav"):
            self.inside.append(tag)
        if tag == "a" and dict(attrs).get("href"):
            self.targets.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if self.inside and tag in ("script", "style", "nav"):
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside and data.strip():
            self.pieces.append(data.strip())


def rows(duck, sql):
    return duck.execute(sql).fetchall()


def check_n3_nfkc(got, duck, sf_dir):
    expected = {i: unicodedata.normalize("NFKC", t + "\ufb01\uff12\xa0e\u0301") for i, t in rows(duck, "SELECT doc_id, text FROM documents")}
    assert {r["doc_id"]: r["text"] for r in got} == expected


def check_h1_page_text(got, duck, sf_dir):
    assert {r["page_id"]: r["text"] for r in got} == {i: "\n".join(Page(h).pieces) for i, h in rows(duck, "SELECT page_id, html FROM pages")}


def check_h2_resolved_links(got, duck, sf_dir):
    same = lambda url, h: " ".join(x for x in (urljoin(url, t) for t in Page(h).targets) if urlparse(x).netloc == urlparse(url).netloc)
    assert {r["page_id"]: r["links"] for r in got} == {i: same(u, h) for i, u, h in rows(duck, "SELECT page_id, url, html FROM pages")}


def check_s6_web_pages(got, duck, sf_dir):
    expected = {}
    for u, h in rows(duck, "SELECT url, min(html) FROM pages WHERE url IS NOT NULL GROUP BY url"):
        if len(t := "\n".join(Page(h).pieces)) >= 200:
            expected[u] = (t[:5000], min(len(t), 5000), urlparse(u).netloc)
    assert {r["url"]: (r["text"], r["chars"], r["domain"]) for r in got} == expected


def plain_crawl(links, start, most):
    queue = seen = [start]
    while queue and len(seen) < most:
        new = [x for u in queue for x in links.get(u, ())]
        queue = [x for n, x in enumerate(new) if x not in seen and x not in new[:n]]
        seen = seen + queue
    return seen[:most]


def links_within_hosts(duck):
    return {u: [urljoin(u, t) for t in Page(h).targets if urlparse(urljoin(u, t)).netloc == urlparse(u).netloc][:20] for u, h in rows(duck, "SELECT url, html FROM pages WHERE url IS NOT NULL ORDER BY page_id DESC")}


def check_s7_crawl(got, duck, sf_dir):
    links = links_within_hosts(duck)
    assert [r["url"] for r in sorted(got, key=lambda r: r["rank"])] == plain_crawl(links, min(links), 50)


def check_s7_crawl_hosts(got, duck, sf_dir):
    links = links_within_hosts(duck)
    starts = {}
    for u in sorted(links, reverse=True):
        starts[urlparse(u).netloc] = u
    expected = {(h, u, n) for h, start in starts.items() for n, u in enumerate(plain_crawl(links, start, 50))}
    assert {(r["host"], r["url"], r["rank"]) for r in got} == expected and len(got) == len(expected)


def check_r8_sentences(got, duck, sf_dir):
    expected = {i: re.split(r"(?<=[.!?])\s+", t)[:5] for i, t in rows(duck, "SELECT doc_id, text FROM documents")}
    assert {r["doc_id"]: r["sentences"] for r in got} == expected


PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[a-zA-ZÀ-ÿ]+| ?[0-9]+| ?[^\s\w]+|\s+")


def check_merges(got, duck, sf_dir):
    """The first merges against the definition: count all pairs anew each time. The rest are compared with plain training in test_operators."""
    words = {}
    for (t,) in rows(duck, "SELECT text FROM documents"):
        for w in PATTERN.findall(t):
            words[w] = words.get(w, 0) + 1
    split = [(list(w.encode()), n) for w, n in words.items()]
    merges = [(r[1], r[2]) for r in sorted(map(tuple, got))]
    assert len(merges) > 1000
    for new, pair in enumerate(merges[:12], 264):
        pairs = {}
        for ids, n in split:
            for p in zip(ids, ids[1:]):
                pairs[p] = pairs.get(p, 0) + n
        assert pair == min(pairs, key=lambda p: (-pairs[p], p))
        for ids, _ in split:
            i = 0
            while i + 1 < len(ids):
                if (ids[i], ids[i + 1]) == pair:
                    ids[i : i + 2] = [new]
                i += 1


@functools.cache
def trained(sf_dir):
    from pyspark.sql import SparkSession

    found = QUERIES["t3_merges"](SparkSession.getActiveSession(), sf_dir).collect()
    return {(r[1], r[2]): 264 + r[0] for r in found}


def merged_word(word, made):
    """One merge at a time: the pair that was learned first, at its leftmost place."""
    ids = list(word.encode())
    while True:
        known = [(made[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in made]
        if not known:
            return ids
        new, i = min(known)
        ids[i : i + 2] = [new]


def plain_ids(text, made, memo={}):  # noqa: B006
    out = []
    for w in PATTERN.findall(text):
        if w not in memo:
            memo[w] = merged_word(w, made)
        out += memo[w]
    return out


def check_t4_encode(got, duck, sf_dir):
    made = trained(sf_dir)
    expected = {i: [258, *plain_ids(t, made), 259] for i, t in rows(duck, "SELECT doc_id, text FROM documents")}
    assert {r["doc_id"]: r["ids"] for r in got} == expected


def check_p2_prepared(got, duck, sf_dir):
    made, flat, expected = trained(sf_dir), [], []
    for (t,) in rows(duck, "SELECT text FROM documents WHERE length(text) >= 50 ORDER BY doc_id")[:-1]:
        flat += plain_ids(t, made)
    while len(flat) - 128 * len(expected) >= 129:
        expected.append(flat[128 * len(expected) :][:129])
    assert sorted((r["seq_id"], r["ids"]) for r in got) == list(enumerate(expected))


@functools.cache
def their_tokenizer():
    import tiktoken

    with open(THEIRS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("theirs", pat_str=THEIR_SPLIT.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={}), ranks


def our_pieces(made):
    pieces = {i: bytes([i]) for i in range(256)}
    for (a, b), i in made.items():
        pieces[i] = pieces[a] + pieces[b]
    return pieces


def check_s12_resumed_tokens(got, duck, sf_dir):
    theirs, _ = their_tokenizer()
    flat = [i for (t,) in rows(duck, "SELECT text FROM documents ORDER BY doc_id") for i in theirs.encode_ordinary(t)]
    expected = [(n, flat[n * 65 : n * 65 + 65], 0 if n < 100 else 1 if n < 250 else 2) for n in range(len(flat) // 65)]
    assert sorted((r["seq_id"], r["ids"], r["run"]) for r in got) == expected


def check_v1_vocab_edges(got, duck, sf_dir):
    made, (theirs, ranks) = trained(sf_dir), their_tokenizer()
    forward = set()
    for i, piece in our_pieces(made).items():
        try:
            forward |= {(t, i) for t in theirs.encode_ordinary(piece.decode())}
        except UnicodeDecodeError:
            continue
    reached, edges = {t for t, _ in forward}, sorted(forward)
    for piece, t in ranks.items():
        text = piece.decode("utf-8", "replace")
        if t < 50_000 and t not in reached and not text.startswith("<"):
            edges += [(t, i) for i in plain_ids(text, made)]
    assert sorted((r["their_id"], r["our_id"]) for r in got) == sorted(edges)


def plain_alignment(text, made, pieces, theirs):
    """(our ids, their ids, the places of theirs that each of ours overlaps), every token against every other."""
    ours, ids = plain_ids(text, made), theirs.encode_ordinary(text)
    spans, pos = [], 0
    for i in ours:
        try:
            n = 1 if i < 256 else len(pieces[i].decode())
        except UnicodeDecodeError:
            n = len(pieces[i])
        spans.append((pos, pos + n))
        pos += n
    starts, at = [], 0
    for c in text:
        starts.append(at)
        at += len(c.encode())
    char_of = [c for c, ch in enumerate(text) for _ in ch.encode()]
    their_spans, at = [], 0
    for i in ids:
        n = len(theirs.decode_single_token_bytes(i))
        their_spans.append((char_of[at], char_of[at + n - 1] + 1))
        at += n
    return ours, ids, [[k for k, (s, e) in enumerate(their_spans) if e > a and s < b] for a, b in spans]


def some_alignments(duck, sf_dir):
    made, (theirs, _) = trained(sf_dir), their_tokenizer()
    pieces = our_pieces(made)
    for i, t in rows(duck, "SELECT doc_id, text FROM documents WHERE length(text) < 2500"):
        yield i, *plain_alignment(t, made, pieces, theirs)


def check_v5_aligned(got, duck, sf_dir):
    got = {r["doc_id"]: r for r in got}
    assert len(got) == rows(duck, "SELECT count(*) FROM documents")[0][0]
    for i, ours, ids, places in some_alignments(duck, sf_dir):
        r = got[i]
        assert (r["our_ids"], r["their_ids"]) == (ours, ids)
        assert [list(range(a, b)) for a, b in zip(r["low"], r["high"])] == places


def check_v6_position_map(got, duck, sf_dir):
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], {})[r["our_idx"]] = (r["their_pos"], [round(w, 9) for w in r["weight"]])
    for i, _, ids, places in some_alignments(duck, sf_dir):
        expected = {}
        for n, hit in enumerate(places):
            cells = {}
            for k in hit:
                for pos in [p for p, x in enumerate(ids) if x == ids[k]]:
                    cells[pos] = cells.get(pos, 0) + 1 / len(hit)
            if cells:
                expected[n] = (sorted(cells), [round(cells[c], 9) for c in sorted(cells)])
        assert found.get(i, {}) == expected


def plain_memory(facts, threshold=0.55):
    """The memory's own loop: every fact against all that were kept before."""
    kept = []
    for pos, fact in sorted(facts):
        mine = set(fact.lower().split())
        if not (len(mine) >= 3 and any(set(k.lower().split()) and len(mine & set(k.lower().split())) / len(mine) >= threshold for _, k in kept)) and fact not in [k for _, k in kept]:
            kept.append((pos, fact))
    return {pos for pos, _ in kept}


def check_d5_learned_facts(got, duck, sf_dir):
    facts = rows(duck, "SELECT conv_id * 1000 + turn, text FROM conversations")
    assert {r["pos"] for r in got if r["is_learned"]} == plain_memory(facts) and len(got) == len(facts)


def plain_loop(pages, length, cap=80, chars=80, least=5, lateness=60, watermark=None):
    """The loop, one page after the other over all learners: (kind, learner, pos, time, topic, entered, waiting, pages, topics)."""
    out, state, known = [], {}, {}

    def end(learner):
        s = state.pop(learner)
        out.append(("session", learner, None, s["until"], None, s["entered"], len(s["queue"]), s["pages"], s["topics"]))

    for at, pos, learner, topics in sorted(pages, key=lambda p: p[:2]):
        if learner in state and at >= state[learner]["until"]:
            end(learner)
        s = state.setdefault(learner, {"until": at + length, "queue": [], "met": set(), "entered": 0, "pages": 0, "topics": 0})
        mine = known.setdefault(learner, set())
        topic = s["queue"].pop(0) if s["queue"] else None
        if topic is not None:
            mine.add(topic.lower())
            s["topics"] += 1
        entered = 0
        for t in topics:
            t = t.strip()
            key = t.lower()[:chars]
            if len(t) >= least and key not in s["met"] | mine and len(s["queue"]) < cap:
                s["queue"].append(t)
                s["met"].add(key)
                entered += 1
        s["entered"] += entered
        s["pages"] += 1
        out.append(("page", learner, pos, at, topic, entered, len(s["queue"]), s["pages"], s["topics"]))
    last = max((p[0] for p in pages), default=0) - lateness
    for learner in [k for k, s in state.items() if s["until"] <= last]:
        end(learner)
    return sorted(out, key=repr)


def loop_rows(got):
    return sorted(((r["kind"], r["learner"], r["pos"], round(r["at"].timestamp()), r["topic"], r["entered"], r["waiting"], r["pages"], r["topics"]) for r in got), key=repr)


def check_d7_learning_loop(got, duck, sf_dir):
    pages = [(86_400 + i * 60, i, s, re.split(r"[.!?\n]", t)) for i, s, t in rows(duck, "SELECT doc_id, source, text FROM documents")]
    assert loop_rows(got) == plain_loop(pages, 3600)


def check_a8_inventory(got, duck, sf_dir):
    sizes = [os.path.getsize(f"{sf_dir}/{f}") for f in os.listdir(sf_dir) if f.endswith(".parquet")]
    assert [tuple(r) for r in got] == [(len(sizes), sum(sizes))]


CHECKS = {
    "n3_nfkc": check_n3_nfkc, "h1_page_text": check_h1_page_text, "h2_resolved_links": check_h2_resolved_links, "s6_web_pages": check_s6_web_pages, "s7_crawl": check_s7_crawl, "s7_crawl_hosts": check_s7_crawl_hosts,
    "r8_sentences": check_r8_sentences, "t3_merges": check_merges, "k6_tokenizer": check_merges, "t4_encode": check_t4_encode, "p2_prepared": check_p2_prepared, "a8_inventory": check_a8_inventory,
    "d5_learned_facts": check_d5_learned_facts, "d7_learning_loop": check_d7_learning_loop, "s12_resumed_tokens": check_s12_resumed_tokens, "v1_vocab_edges": check_v1_vocab_edges, "v5_aligned": check_v5_aligned, "v6_position_map": check_v6_position_map,
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert_same(df, duck, ORACLE[name])
    else:
        CHECKS[name](df.collect(), duck, sf_dir)


def test_json_is_whole(spark, tmp_path):
    from loomtext.sources import writers

    writers.tokenizer(spark, str(tmp_path / "t.json"), [(104, 101)])
    saved = json.loads((tmp_path / "t.json").read_text())
    assert saved["merges"] == [[104, 101]] and saved["vocab"]["264"] == "he"
