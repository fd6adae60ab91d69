"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; each distinct word is folded once over its byte array: of all
neighbours, the pair whose joined bytes have the lowest rank is merged, until no pair has a rank.  The rank map
travels as a literal with the function.  Ids stand for byte strings, and decoding concatenates those.

The fold runs in Arrow batches and not in Spark's higher-order functions: those evaluate a fold without
generated code, too slow for the millions of distinct words of a corpus (the README has figures).  A worker remembers
the ids of up to ``MEMO`` words that it has met last, a bound on memory that changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import by_value, lean

#: Distinct words whose ids a worker keeps, in two halves: when the newer one is full, the older one goes.
MEMO = 400_000
#: Rows that go out together; their ids are held until then.
ROWS = 512
#: Words of more bytes are merged with a heap, as a scan of all pairs takes time in the square of the length.
SCAN_BYTES = 64
#: Unicode's White_Space, which the pattern's \s means (Python's has U+001C to U+001F besides).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``; the driver reads it, and it has the size of one vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def exact_pattern(pattern: str) -> str:
    """The pattern with its white space spelled out."""
    return pattern.replace("[^\\s", "[^" + WHITE_SPACE).replace("\\s", f"[{WHITE_SPACE}]").replace("\\S", f"[^{WHITE_SPACE}]")


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: merge the leftmost pair of lowest rank again and again."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of candidate pairs: n log n steps."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # a part is word[i:end[i]]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        alive[end[i]] = False
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return merge_scan(word, ranks) if len(word) <= SCAN_BYTES else merge_heap(word, ranks)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ``ids`` or the digests of ids and of the decoded bytes, for each row.

    No special tokens: their strings are ordinary text.  The digests are SHA-256 in hexadecimal, of the decimal
    ids joined by one space and of the bytes to which ``decode`` turns the ids.

    * null or empty text: no ids; the digests are those of nothing.
    * long words: exact at any length.  Repeated rows: one result each.  Empty table: no rows.
    * other columns are ignored, whatever their names.
    """
    fields = [docs.select(F.col(id_col).alias("doc_id")).schema[0], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField(x, T.StringType()) for x in ("ids_sha256", "decoded_sha256") if digests]
    spelled = exact_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(spelled).findall
        pieces = {i: p for p, i in ranks.items()}
        newer: dict[str, list[int]] = {}
        older: dict[str, list[int]] = {}
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, out_ids, hashes = [], [], ([], [])
            for text in batch.column(1).to_pylist():
                row: list[int] = []
                for word in split(text or ""):
                    got = newer.get(word)
                    if got is None:
                        if len(newer) >= MEMO // 2:
                            newer, older = {}, newer
                        got = newer[word] = older.get(word) or merge(word.encode(), ranks)
                    row += got
                counts.append(len(row))
                if ids:
                    out_ids.append(pa.array(row, pa.int32()))
                if digests:
                    hashes[0].append(hashlib.sha256(" ".join(map(str, row)).encode()).hexdigest())
                    hashes[1].append(hashlib.sha256(b"".join(map(pieces.__getitem__, row))).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if ids:
                ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(out_ids)))
            columns += [pa.array(h, pa.string()) for h in hashes if digests]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), T.StructType(fields))


def folded(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 1 << 16) -> DataFrame:
    """``words`` with ``ids``: the same fold in Spark's higher-order functions, with the rank map as a literal.

    For tables of distinct words, such as a vocabulary to be encoded once; ``encoded`` gives the same ids.  Bytes are written in
    hexadecimal, and the map is laid out in buckets by CRC-32, as a lookup in a Spark map is linear.  A null word gives null, the
    empty word no ids.
    """
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        table[zlib.crc32(key.encode()) % buckets][key] = rank
    literal = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<map<string,int>>")
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  computes the value once
    none, pair = F.array().cast("array<int>"), "struct<parts:array<string>,ranks:array<int>>"

    def fold(word: Column, maps: Column) -> Column:
        look = lambda key: F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % buckets).cast("int")), key)
        n = (F.length(word) / 2).cast("int")
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, 2 * i - 1, F.lit(2)))
        first = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: look(F.substring(word, 2 * i - 1, F.lit(4))))).otherwise(none)

        def merge_at(acc: Column, i: Column) -> Column:
            def joined(new: Column) -> Column:
                left = F.when(i > 1, F.array(look(F.concat(F.get(acc["parts"], i - 2), new)))).otherwise(none)
                right = F.when(i + 1 < F.size(acc["parts"]), F.array(look(F.concat(new, F.get(acc["parts"], i + 1))))).otherwise(none)
                after = F.concat(F.slice(acc["parts"], F.lit(1), i - 1), F.array(new), F.slice(acc["parts"], i + 2, F.size(acc["parts"])))
                ranks_after = F.concat(F.slice(acc["ranks"], F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(acc["ranks"], i + 2, F.size(acc["parts"])))
                return F.struct(after.alias("parts"), ranks_after.alias("ranks")).cast(pair)

            return once(F.concat(F.get(acc["parts"], i - 1), F.get(acc["parts"], i)), joined)

        def step(acc: Column, _: Column) -> Column:
            low = F.array_min(acc["ranks"])
            return F.when(low.isNull(), acc).otherwise(once(F.array_position(acc["ranks"], low).cast("int"), lambda i: merge_at(acc, i)))

        merged = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.struct(parts.alias("parts"), first.alias("ranks")).cast(pair), step, lambda acc: F.transform(acc["parts"], look))
        whole = lambda rank: F.when(rank.isNotNull(), F.array(rank)).when(n < 1, none).otherwise(merged)
        return F.when(word.isNotNull(), once(look(word), whole))

    return words.withColumn("ids", once(literal, lambda maps: fold(F.hex(F.encode(F.col(word_col), "UTF-8")), maps)))


def decoded(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the binary column ``to``: the concatenated pieces of ``ids``; unknown ids raise, null gives null."""
    pieces = {i: p for p, i in ranks.items()}

    @F.pandas_udf("binary")
    def join(column):
        return column.map(lambda ids: None if ids is None else b"".join(pieces[i] for i in ids))

    return rows.withColumn(to, join(F.col(ids_col)))


by_value(__name__)
