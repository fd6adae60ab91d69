"""Divergence audit, WARC archives and fill-in-middle against plain programs, and on the cases that their docstrings define."""

import base64
import collections
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.llm import divergence, fill_middle, warc

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# 11
def plain_audit(rows, min_docs, top):
    """(lang, source, part, item, value, rank) by the formulas, term by term."""
    rows = [(a or "", b or "", TERM.findall(lower(c or ""))) for a, b, c in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = collections.Counter(t for r in mine for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        count = collections.defaultdict(collections.Counter)
        for _, s, words in mine:
            count[s].update(w for w in words if w in kept)
        total = sum(count.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(total, t) for t in kept}
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def audited(df, **kw):
    got = divergence.audit(df, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def mixed(spark):
    """Frequent and rare words over seven sources, with nulls, empty texts, repeated rows, and columns of the operator's own names."""
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "ÉCOLE", "œuf", "中文", "\U0001f600"]
    rows = []
    for n in range(400):
        s = rng.choice(["a", "a", "a", "b", "c", "d", "e", "é", "", None])
        words = [vocabulary[min(int(rng.expovariate(0.03)), len(vocabulary) - 1)] for _ in range(rng.randint(0, 40))]
        words += [f"own{s}"] * rng.randint(0, 2)
        rows.append((rng.choice(["en", "en", None, "fr"]), s, rng.choice([" ", "_", "\n1"]).join(words)))
    rows += [("en", "a", None), ("de", "x", "seul"), ("de", "y", None), ("it", None, "")] + rows[:20]
    return rows, spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "lang string, source string, text string, term int, p int, i int, n int")


@pytest.mark.parametrize("light,dense", [(1024, 8), (1024, 1), (1, 1), (3, 2), (0, 8)])
def test_heavy_and_light_sums_agree_with_the_plain_sum(mixed, light, dense, monkeypatch):
    rows, df = mixed
    monkeypatch.setattr(divergence, "TILE", 3 if light < 4 else 128)
    assert audited(df, min_docs=6, top=7, light=light, dense=dense) == plain_audit(rows, 6, 7)


def test_audit_of_all_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]
    assert audited(df) == plain_audit(rows, 30, 50)


def test_audit_of_empty_table(mixed):
    assert audited(mixed[1].filter("n > 9")) == []


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(divergence, "_BLOCK", 10)
    for text in (b"", b"a" * 35, b"abc def ghi jkl mno", b"a " * 30, b" " * 25, b"x" * 15 + b" y"):
        parts = list(divergence.parts(text))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


# 12
def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain_pages(rows, least=0):
    out = []
    for i, html in rows:
        size = len((html or "").encode())
        same = [j for j, h in rows if (h or "") == (html or "")]
        top = max(same, key=lambda j: (j is not None, j))
        out.append((i, size, digest(html), "revisit" if size >= least and i != top else "response", top if size >= least and i != top else None))
    return sorted(out, key=str)


PAGES = [
    (1, "<p>é</p>"), (2, None), (3, ""), (4, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (5, "\r\n\r\n"), (6, "\n\r\n\r\r\n\r\n"),
    (7, "<p>é</p>"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "\x00\x01 \U0001f600"), (None, "<p>é</p>"), (-3, "un"), (12, "un"),
]


@pytest.mark.parametrize("least", [0, 3])
def test_archives_give_pages_back(spark, least):
    rows = [(i, [None, "http://h.org/a?b#c", "https://h.org", "no url", "a\r\nWARC-Type: x"][n % 5], html, 0, "x", "y") for n, (i, html) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at int, digest string, id string").repartition(3)
    df = warc.settled(df)
    got = warc.archived(spark, df, min_bytes=least).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pages(PAGES, least)
    urls = {i: u for i, u, *_ in rows if u and "\r" not in u}
    assert all(r["target_uri"] == urls[r["page_id"]] for r in got if r["page_id"] in urls)


def test_rows_that_repeat_everything_leave_one_response(spark):
    df = warc.settled(spark.createDataFrame([(5, "u", "same")] * 3 + [(4, "u", "same")], "page_id long, url string, html string"))
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(spark, df).collect())
    assert [g[:2] for g in got] == [(4, "revisit"), (5, "response"), (5, "revisit"), (5, "revisit")] and {g[2] for g in got if g[1] == "revisit"} == {5}
    assert warc.archived(spark, df.filter("page_id > 9")).count() == 0


def foreign(*records):
    out = b""
    for fields, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in fields)
        out += f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_foreign_archives_in_any_order(spark, tmp_path):
    """A gzip member for each record, names in other case, a folded field, records of one capture in two files, naming in both directions."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + bytes(range(256))
    one = [([("WARC-Type", "warcinfo"), ("warc-record-id", "<i>")], b"software: x\r\n"), ([("WARC-Type", "request"), ("WARC-Record-ID", "<q1>"), ("WARC-Concurrent-To", "<r1>"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
           ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<r1>"), ("X", "a\r\n b")], b"k: v")]
    two = [([("WARC-TYPE", "response"), ("WARC-Record-ID", "<r1>"), ("WARC-Concurrent-To", "<q2>"), ("Content-Type", "application/http; msgtype=response")], http), ([("WARC-Type", "request"), ("WARC-Record-ID", "<q2>")], b""), ([("WARC-Type", "resource"), ("WARC-Record-ID", "<r2>")], b"alone")]
    for name, records in (("a", one), ("b", two)):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(gzip.compress(foreign(r)) for r in records))
    got = {r["capture"]["record_id"]: r for r in warc.captures(warc.read(spark, str(tmp_path), bodies=True)).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    r = got["<r1>"]
    assert [x["record_id"] for x in r["requests"]] == ["<q1>", "<q2>"] and [x["record_id"] for x in r["metadata"]] == ["<m1>"]
    assert bytes(r["capture"]["body"]) == bytes(range(256)) and r["capture"]["body_bytes"] == 256 and r["capture"]["http"].endswith("A: b")
    assert (got["<r2>"]["requests"], got["<r2>"]["metadata"]) == ([], [])


@pytest.mark.parametrize("cut", [5, 60, 200])
def test_a_broken_archive_raises(spark, tmp_path, cut):
    whole = foreign(([("WARC-Type", "resource"), ("WARC-Record-ID", "<r>")], b"x" * 500))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole[:cut] if cut > 50 else b"none" + whole))
    with pytest.raises(Exception, match="archive ends within|no record begins"):
        warc.read(spark, str(tmp_path)).collect()


def test_warc_digest_of_columns(spark):
    for text in ("", "a", "é" * 99):
        assert spark.range(1).select(warc.base32_sha1(F.lit(text))).first()[0] == digest(text)


# 13
def plain_cut(i, text, rate=90, spm_rate=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm_rate else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm_rate", [(90, 20), (100, 100), (100, 0), (0, 0)])
def test_cuts_and_their_restoration(spark, sf_dir, rate, spm_rate):
    texts = [None, "", " ", "a", "é \U0001f469‍\U0001f469‍\U0001f467 中文\r\n ", "with <P> inside", "<S", "<<P", "<P<S<M", "x" * 3000 + " \n" * 50, "\x00\t"]
    rows = [(i, t, "x") for i, t in enumerate(texts * 30)] + [(None, "null id", "x"), (None, None, "x"), (4, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    got = fill_middle.transformed(df, rate=rate, spm_rate=spm_rate)
    back = sorted(map(str, (tuple(r) for r in got.withColumn("back", fill_middle.restored()).collect())))
    assert back == sorted(str((*plain_cut(i, t, rate, spm_rate), t or "")) for i, t, _ in rows)
    assert fill_middle.transformed(df.filter("doc_id > 10000")).count() == 0


def test_cuts_of_all_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(str, map(tuple, fill_middle.transformed(df).collect())))
    assert got == sorted(str(plain_cut(r["doc_id"], r["text"])) for r in df.collect())


def test_blocks_and_long_words_change_no_offset(monkeypatch):
    monkeypatch.setattr(fill_middle, "_BLOCK", 50)
    monkeypatch.setattr(fill_middle, "_WORD", 7)
    monkeypatch.setattr(fill_middle, "_KNOWN", 5)
    o = fill_middle.Offsets()
    for text in ("", "a", " " * 120, "é" * 120, "ab cd \U0001f600 " * 20, "x" * 49 + " " + "y" * 51):
        blocks = o.count(text)
        assert sum(blocks) == len(text) and [o.at(text, blocks, r) for r in range(len(text) + 1)] == list(range(len(text) + 1))
