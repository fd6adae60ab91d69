"""Line de-duplication by pairwise alignment.

A line alone is a poor sign of overlap, as short ones are frequent, so what is hashed are runs, which are rare: for each line the
shortest run of consecutive lines, blank ones aside, that begins with it and has ``BLOCK_WORDS`` words, and the
shortest one that ends with it.  There are at most two runs a line, and a line of so many words is its own run.  Runs that
a single document holds are dropped at once.  Any other run names its first holder as a partner of each later document, so
a run in a third of all documents gives one pair for each of them and never all pairs, and no cap is needed.

Each pair is aligned as a whole, over all runs that both have, by patience diff: what both begin and end with is aligned, then the runs that
each has once are anchors, of which the longest sequence that is in order in both is kept, and the stretches between anchors are aligned in the same way.  A
stretch without anchors has repeated runs only; there the n-th place of a run in one document answers the n-th in the other.  The lines of aligned
runs, which are blocks of ``block_words`` words or more, are deleted from the later document.

So what both have but in another order stays, but for the longest part that is in order: of two blocks that changed places one stays, and a
run that the later document has more often than the earlier is deleted as often as that has it.  A line goes if any of the document's partners aligns it.

Later means the larger id.  The alignment sees hashes and line numbers only; texts are shuffled once, to take the lines out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import _starts, by_value, lean, runs, settled, texts_of

#: Words that a block must have to be deleted: shorter ones repeat by chance.
BLOCK_WORDS = 5


def run_keys(text: bytes, block_words: int = BLOCK_WORDS) -> list[tuple[int, int, list[int] | None, int, int]]:
    """(first line, its place among the lines with words, the run's further lines, two halves of the 128-bit key) of each run."""
    lines, at, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            lines.append(line)
            at.append(i)
            words.append(n)
    spans = set()
    end, total = 0, 0
    for start, n in enumerate(words):  # the shortest run from each line on
        while end < len(words) and total < block_words:
            total += words[end]
            end += 1
        if total < block_words:
            break
        spans.add((start, end))
        total -= n
    start, total = len(words), 0
    for end in range(len(words), 0, -1):  # and back from each line
        while start and total < block_words:
            start -= 1
            total += words[start]
        if total < block_words:
            break
        spans.add((start, end))
        total -= words[end - 1]
    out = []
    for start, end in sorted(spans):
        key = xxhash.xxh3_128_intdigest(lines[start] if end - start == 1 else b"\n".join(lines[start:end]))
        out.append((at[start], start, at[start + 1 : end] or None, _signed(key >> 64), _signed(key & (1 << 64) - 1)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of (mine, other), given by ascending mine, in which other ascends too; of several the one that ends least, and so on back."""
    tops: list[int] = []  # the least end of a sequence of each length
    where: list[int] = []
    before: list[int] = []
    for n, (_, other) in enumerate(anchors):
        place = bisect_left(tops, other)
        before.append(where[place - 1] if place else -1)
        tops[place : place + 1] = [other]
        where[place : place + 1] = [n]
    out, n = [], where[-1] if where else -1
    while n >= 0:
        out.append(anchors[n])
        n = before[n]
    return out[::-1]


def aligned(mine: list, other: list) -> list[tuple[int, int]]:
    """Places (in mine, in other) that a patience diff of two sequences aligns, unordered."""
    out: list[tuple[int, int]] = []
    stretches = [(0, len(mine), 0, len(other))]
    while stretches:
        a, a_end, b, b_end = stretches.pop()
        while a < a_end and b < b_end and mine[a] == other[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and mine[a_end - 1] == other[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        places: dict = {}
        for j in range(b, b_end):
            places.setdefault(other[j], []).append(j)
        times = Counter(mine[a:a_end])
        anchors = [(i, places[mine[i]][0]) for i in range(a, a_end) if times[mine[i]] == 1 and len(places.get(mine[i], ())) == 1]
        if anchors:
            kept = increasing(anchors)
            out += kept
            for i, j in [*kept, (a_end, b_end)]:
                stretches.append((a, i, b, j))
                a, b = i + 1, j + 1
        else:
            nth: Counter = Counter()
            for i in range(a, a_end):
                n = nth[mine[i]]
                nth[mine[i]] += 1
                if n < len(places.get(mine[i], ())):
                    anchors.append((i, places[mine[i]][n]))
            out += increasing(anchors)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_key, line, other: the lines (from 0) to delete from a document, with the earlier document that holds them.

    A document is an id with a text; ``text_key`` is the text's 64-bit hash and tells texts of one id apart.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    kind = rows.schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64())
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                found = run_keys(text, block_words)
                keys += found
                ids += [i] * len(found)
            columns = list(zip(*keys, strict=True)) or [[]] * 5
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "text_key", "line", "place", "rest", "h", "l"])

    lines = settled(rows.mapInArrow(lean(cut), f"doc_id {kind}, text_key bigint, line int, place int, rest array<int>, h bigint, l bigint"))
    first = F.min(F.struct("doc_id", "text_key")).alias("f")
    shared = settled(lines.groupBy("h", "l").agg(first, F.max("doc_id").alias("last")).filter("f.doc_id < last").select("h", "l", F.col("f.doc_id").alias("other"), F.col("f.text_key").alias("other_key")))
    held = settled(lines.join(shared, ["h", "l"]))
    pairs = held.filter("doc_id > other").select("doc_id", "text_key", "other", "other_key").distinct()
    span = F.coalesce(F.size("rest"), F.lit(0)).alias("span")
    mine = pairs.join(held.select("doc_id", "text_key", "line", "place", "rest", span, "h", "l"), ["doc_id", "text_key"])
    # saved, so that a first holder of very many documents' runs comes by an exchange of its own and can be split
    theirs = settled(held.groupBy(F.col("doc_id").alias("other"), F.col("text_key").alias("other_key"), "h", "l").agg(F.collect_list("place").alias("at")))
    matches = mine.join(theirs, ["other", "other_key", "h", "l"]).select("doc_id", "text_key", "other", "other_key", "place", "span", "line", "rest", "h", "l", "at")
    key = ["doc_id", "text_key", "other", "other_key"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, key):
            bounds = np.append(_starts(table, key), table.num_rows).tolist()
            span, line, rest, h, low, at = (table.column(c).to_pylist() for c in ("span", "line", "rest", "h", "l", "at"))
            rows, gone = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine = [(h[i], low[i]) for i in range(a, b)]  # by place and span, as sorted
                other = sorted({(place, span[i], h[i], low[i]) for i in range(a, b) for place in at[i]})
                found = {x for i, _ in aligned(mine, [x[2:] for x in other]) for x in (line[a + i], *(rest[a + i] or ()))}
                rows += [a] * len(found)
                gone += sorted(found)
            part = table.select(key[:3]).take(pa.array(rows, pa.int64())).add_column(2, "line", pa.array(gone, pa.int32()))
            yield from part.combine_chunks().to_batches()

    dealt = matches.repartition(*key).sortWithinPartitions(*key, "place", "span")
    return dealt.mapInArrow(lean(align), f"doc_id {kind}, text_key bigint, line int, other {kind}")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the aligned common blocks taken out of ``text_col``, and the column ``removed_lines``.

    ``removed_lines`` is an array of structs (line, other), by line; ``line`` counts from 0 in the text as it was.

    * null text: stays null.  Null id: the row is neither earlier nor later than any other and stays as it is.
    * a copy of an earlier document: its text becomes empty (or its blank lines).  Lines without a word are never deleted.
    * a text of fewer than ``block_words`` words has no block and stays.  A block that stands elsewhere than the alignment has it stays.
    * rows that repeat an id do not delete each other's lines; each loses what its own text shares with smaller ids.
    * empty table: no rows.  Other columns stay as they are, whatever their names, but ``removed_lines`` is replaced.
    """
    own = [c for c in docs.columns if c != "removed_lines"]
    gone = removals(docs, id_col, text_col, block_words).groupBy("doc_id", "text_key", "line").agg(F.min("other").alias("other"))
    gone = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("line", "other"))).alias("removed_lines"))
    # the table's own columns stand aside, as names may clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != text_col]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(gone, ["doc_id", "text_key"], "left")
    numbers = F.transform("removed_lines", lambda x: x["line"])

    def rebuilt(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)  # by a hash set, linear in the lines
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), rebuilt), F.lit(0))
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own], "removed_lines")


by_value(__name__)
