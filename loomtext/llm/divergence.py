"""Source divergence audit: how far the sources of a language stand apart in their words, term by term and pair by pair.

Each group, a source within a language, has a smoothed share ``p`` of every kept term, as an integer of ``SCALE``.  A pair of groups differs by the
sum of ``abs(p - q)`` over all kept terms.  That sum is split into heavy and light terms:

* Heavy terms, which many groups have, are dense vectors over the groups.  Blocks of ``TILE`` groups meet in numpy tiles, terms down one side.
* Light terms are absent from most groups, where their share is the group's constant ``p0``.  If all light terms were absent everywhere, the pair (i, j) would
  differ by their number times ``abs(p0_i - p0_j)``.  A group's own light terms correct that for each partner, which takes the group's distinct shares and the
  partner's ``p0`` alone.  Where both have the term, a sparse correction from the term's postings puts right what the two did apart.

The partial sums are integers and add up exactly.  Work of a light term grows with the square of its postings, at most ``LIGHT`` of them, and work of a
heavy one with the square of the groups, which is no more than the pairs that are returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import by_value, lean, runs, settled, texts_of

SCALE = 1_000_000_000
#: Added to each count.
SMOOTH = 5
#: Documents of a language that a kept term is in at least.
MIN_DOCS = 30
#: Terms of a group that are reported.
TOP = 50
#: A term is light in at most LIGHT groups, and in at most one of DENSE of its language's.
LIGHT, DENSE = 1024, 8
#: Groups of a side of a tile, and the parts that a tile's terms are dealt to.
TILE, PARTS = 128, 32
_HELD, _BLOCK = 300_000, 1 << 22  # terms counted at a time, bytes of a text read at a time
#: Every byte that belongs to no term becomes a space, and A-Z become a-z.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, summed up to _HELD terms at a time."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        held = sum(len(n) for n, _ in groups.values())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, here = len(n), set()
            for part in parts(text.translate(_TERMS)):
                words = part.split(b" ")
                n.update(words)
                here.update(words)
            docs.update(here)
            for x in (n, docs):
                x.pop(b"", None)
            held += len(n) - before
            if held > _HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def parts(text: bytes) -> Iterator[bytes]:
    """``text`` cut at spaces into pieces of about _BLOCK bytes, so that the words of a very long text are not held at once."""
    a = 0
    while len(text) - a > _BLOCK:
        b = text.rfind(b" ", a, a + _BLOCK)
        b = b if b > a else text.find(b" ", a + _BLOCK)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), null without terms: integral division of decimals is exact and gives a long."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div nullif({total} + {SMOOTH} * {v}, 0)")


def shares(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups, and the kept terms that each of them has.

    groups: lang, source, i (from 0 by source), s (groups of the language), v (kept terms), p0 (share of an absent term; 0 without terms).
    terms: lang, source, i, s, term, k (groups that have it), p (the group's share), q (the language's), p0.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), part(text_col).alias("text"))
    counts = rows.mapInArrow(lean(_tally), "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("has"), F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = settled(kept.withColumn("k", F.size("has")))

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    each = kept.select("lang", "term", "k", "lang_n", F.explode("has").alias("x")).select("lang", "term", "k", "lang_n", "x.source", "x.n")
    of_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(each.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total"]).withColumn("i", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("s", F.count("*").over(of_lang).cast("int"))
    groups = settled(groups.withColumn("p0", F.coalesce(_share("0", "total", "v"), F.lit(0))))
    terms = each.join(groups, ["lang", "source"]).select("lang", "source", "i", "s", "term", "k", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"), "p0")
    return groups.select("lang", "source", "i", "s", "v", "p0"), settled(terms)


_SUMS = "lang string, i int, j int, f bigint"


def _rows(lang: list[str], i: np.ndarray, j: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """Sums of pairs, the lesser group first."""
    columns = [pa.array(lang, pa.string()), *(pa.array(x, t) for x, t in ((np.minimum(i, j), pa.int32()), (np.maximum(i, j), pa.int32()), (f, pa.int64())))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "i", "j", "f"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heavy terms: rows (lang, a, b, left, right) sorted by tile, left and right being the shares of the tile's two blocks of groups."""
    for table in runs(batches, ["lang", "a", "b"], most=2048):
        key = [table.column(c).to_pylist() for c in ("lang", "a", "b")]
        left, right = (table.column(c).to_pylist() for c in ("left", "right"))
        at = 0
        while at < len(left):
            end = at + 1
            while end < len(left) and all(k[end] == k[at] for k in key):
                end += 1
            x, y = np.array(left[at:end], np.int64), np.array(right[at:end], np.int64)
            f = np.stack([np.abs(x[:, g : g + 1] - y).sum(0) for g in range(x.shape[1])])
            i, j = (n.ravel() for n in np.indices(f.shape))
            i, j = i + key[1][at] * TILE, j + key[2][at] * TILE
            on = np.flatnonzero(i < j)
            yield _rows([key[0][at]] * len(on), i[on], j[on], f.ravel()[on])
            at = end


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light terms in two groups of a posting (i, p, p0): what the groups' own corrections made wrong."""

    def summed(lang: str) -> pa.RecordBatch:
        i, j, f = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((j, i))
        i, j, f = i[order], j[order], f[order]
        at = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        return _rows([lang] * len(at), i[at], j[at], np.add.reduceat(f, at))

    for batch in batches:
        now, found, held = None, [], 0
        for lang, has in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
            if found and (lang != now or held > 1 << 20):
                yield summed(now)
                found, held = [], 0
            now = lang
            g, p, p0 = (np.array([x[c] for x in has], np.int64) for c in ("i", "p", "p0"))
            a, b = np.triu_indices(len(g), 1)
            found.append((g[a], g[b], np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p[b] - p0[a]) + np.abs(p0[a] - p0[b])))
            held += len(a)
        if found:
            yield summed(now)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light terms of group i against every other group as if that had none: rows (lang, i, p0, p, m, others, light), m the terms that have share p."""
    for batch in batches:
        for r in batch.to_pylist():
            p, m = np.array(r["p"] or [], np.int64), np.array(r["m"] or [], np.int64)
            order = np.argsort(p)
            p, m = p[order], m[order]
            x, j = np.array(r["others"], np.int64), np.arange(len(r["others"]))
            upto, mass = np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(m * p)]
            at = np.searchsorted(p, x, "right")
            f = x * upto[at] - mass[at] + (mass[-1] - mass[at]) - x * (upto[-1] - upto[at])  # sum of m * abs(p - x)
            f += np.where(j > r["i"], r["light"], 0) * np.abs(x - r["p0"]) - upto[-1] * np.abs(x - r["p0"])
            on = np.flatnonzero(j != r["i"])
            yield _rows([r["lang"]] * len(on), np.full(len(on), r["i"]), j[on], f[on])


def pair_sums(groups: DataFrame, terms: DataFrame, light: int = LIGHT, dense: int = DENSE) -> DataFrame:
    """lang, i, j, f: for each two groups of a language, i < j, the sum of the differences of their shares over all kept terms."""
    terms = terms.withColumn("heavy", (F.col("k") * dense >= F.col("s")) | (F.col("k") > light))
    langs = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p0"))), lambda x: x["p0"]).alias("others"))

    posts = terms.groupBy("lang", "term", "heavy").agg(F.collect_list(F.struct("i", "p", "p0")).alias("has"))
    block = lambda c, b: F.slice(c, b * TILE + 1, F.lit(TILE))
    vector = F.map_from_entries(F.transform("has", lambda x: F.struct(x["i"], x["p"])))
    full = posts.filter("heavy").join(langs, "lang").select("lang", "term", F.transform("others", lambda p0, i: F.coalesce(F.try_element_at(vector, i), p0)).alias("p"))
    last = F.floor((F.size("p") - 1) / TILE).cast("int")
    tiles = full.withColumn("a", F.explode(F.sequence(F.lit(0), last))).withColumn("b", F.explode(F.sequence(F.col("a"), last)))
    tiles = tiles.select("lang", "a", "b", F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("part"), block("p", F.col("a")).alias("left"), block("p", F.col("b")).alias("right"))
    tiles = tiles.repartition("lang", "a", "b", "part").drop("part").sortWithinPartitions("lang", "a", "b").mapInArrow(lean(_tiles), _SUMS)

    both = posts.filter(~F.col("heavy") & (F.size("has") > 1)).select("lang", F.array_sort("has").alias("has")).mapInArrow(lean(_both), _SUMS)

    own = terms.filter("not heavy").groupBy("lang", "i", "p").agg(F.count("*").alias("m"))
    own = own.groupBy("lang", "i").agg(F.collect_list(F.struct("p", "m")).alias("x"))
    n_light = posts.filter("not heavy").groupBy("lang").agg(F.count("*").alias("light"))
    apart = groups.join(own, ["lang", "i"], "left").join(langs.join(n_light, "lang", "left"), "lang")
    apart = apart.select("lang", "i", "p0", F.col("x.p").alias("p"), F.col("x.m").alias("m"), "others", F.coalesce("light", F.lit(0)).alias("light")).mapInArrow(lean(_apart), _SUMS)
    return tiles.unionByName(both).unionByName(apart).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, light: int = LIGHT, dense: int = DENSE) -> DataFrame:
    """lang, source, part, item, value, rank for each group of ``docs``.

    Part ``pair``: each other source of the language with the sum of differences, all of them.  Part ``term``: the terms of the group that are more
    frequent there than in the language, with the difference, ``top`` of them.  Ranks from 1 by value, descending, then item.

    * null text, language or source: as the empty one.  A group without terms has all shares equal.  A language without kept terms: pairs of value 0.
    * repeated rows each count.  Empty table: no rows.  Very long texts are read in blocks.  Other columns are ignored, whatever their names.
    * terms: runs of letters a-z, A-Z (as a-z) and of all characters beyond ASCII.
    """
    groups, terms = shares(docs, text_col, lang_col, source_col, min_docs)
    sums = pair_sums(groups, terms, light, dense)
    sums = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "f"))
    named = groups.select("lang", "i", "source")
    pairs = sums.join(named, ["lang", "i"]).join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value"))
    more = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))


by_value(__name__)
