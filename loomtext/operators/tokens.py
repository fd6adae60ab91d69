"""Byte-pair tokenizer training and encoding, and packing of token streams.

Merges are learned by ``loomtext.operators.training``.  Encoding folds each distinct word of a batch once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.config import BOS, EOS
from loomtext.functions.text import FAST_SPACE, SPACE
from loomtext.operators.mix import first_rows, running_sum
from loomtext.operators.training import BASE, SCAN_IDS, folded, settled
from loomtext.session import saved

#: Distinct words that a task remembers, and rows that it encodes at a time.
MEMO, ROWS = 500_000, 512

#: How texts are split into words before merging. Letters are ASCII and U+00C0 to U+00FF; what no branch takes, such as
#: an underscore or other alphabets, is dropped.
BRANCHES = r"'(?:s|t|re|ve|m|ll|d)| ?[a-zA-Z\x{{C0}}-\x{{FF}}]+| ?[0-9]+| ?[^{0}\p{{L}}\p{{N}}_]+|[{0}]+"
SPLIT = BRANCHES.format(SPACE)


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + BRANCHES.format(FAST_SPACE)), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: pre-tokens over all documents; partial counts are summed before the shuffle."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def encode_word(word: str, rank: dict[tuple[int, int], int]) -> list[int]:
    return folded(list(word.encode()), rank, BASE)


def _spelled(column: pa.ListArray, ids_of, ends: bool) -> pa.ListArray:
    """The ids of each row's words, one after the other; ``ids_of`` gives those of distinct words, and rows are gathered from them."""
    coded = column.flatten().dictionary_encode()
    lists = ids_of(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    pool, begins, codes = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
    n = sizes[codes]
    to = np.cumsum(n)
    ids = pool[np.repeat(begins[codes] - (to - n), n) + np.arange(n.sum())]
    rows = np.r_[0, to][np.r_[0, np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))]]
    if ends:  # the end of a row stands before the begin of the next
        ids = np.insert(ids, np.stack([rows[:-1], rows[1:]], 1).ravel(), np.tile(np.array([BOS, EOS], np.int32), len(column)))
        rows = rows + 2 * np.arange(len(rows))
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))


def _by_words(fold, keys: np.ndarray, made: np.ndarray, one: bool, of_bytes: np.ndarray, ends: bool = False):
    """An Arrow function from an array of words to ids, had once for each word that a task remembers.

    The new words of some rows are folded together by ``settled``, from the ids ``of_bytes`` of their bytes; long ones by ``fold``, each by itself.
    """

    def folds(words: list[str]) -> Iterator[tuple[str, list[int]]]:
        raw = [w.encode() for w in words]
        short = [i for i, r in enumerate(raw) if 0 < len(r) <= SCAN_IDS]
        flat = of_bytes[np.frombuffer(b"".join(raw[i] for i in short), np.uint8)]
        if len(flat) and flat.min() < 0:
            raise KeyError("a byte that the vocabulary does not have")
        for at, sizes, ids in settled(flat, np.fromiter((len(raw[i]) for i in short), np.int64, len(short)), keys, made, one):
            ids, to = ids.tolist(), np.cumsum(sizes)
            for i, b, e in zip(at.tolist(), (to - sizes).tolist(), to.tolist(), strict=True):
                yield words[short[i]], ids[b:e]
        yield from ((w, fold(w)) for w, r in zip(words, raw, strict=True) if not 0 < len(r) <= SCAN_IDS)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, list[int]] = {}

        def ids_of(words: list[str]) -> list[list[int]]:
            if len(memo) > MEMO:
                memo.clear()
            memo.update(folds([w for w in words if w not in memo]))
            return [memo[w] for w in words]

        for column in batches:
            parts = [_spelled(column.slice(at, ROWS), ids_of, ends) for at in range(0, len(column), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode


def encoder(merges: list[tuple[int, int]], ends: bool = False):
    """An Arrow function from an array of words to ids; ``ends`` adds BOS and EOS."""
    rank = {p: i for i, p in enumerate(merges)}
    keys = np.array([a << 32 | b for a, b in merges], np.int64)
    made = BASE + np.argsort(keys)
    return _by_words(lambda w: encode_word(w, rank), np.sort(keys), made, False, np.arange(256), ends)


def rank_encoder(ranks: dict[bytes, int]):
    """An Arrow function from an array of words to ids of a vocabulary of pieces: neighbours are joined while their joint piece has a rank, the least first."""
    joins = {a << 32 | b: i for piece, i in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None}
    keys, made = np.array(list(joins), np.int64), np.array(list(joins.values()), np.int64)
    order = np.argsort(keys)

    def fold(word: str) -> list[int]:
        raw = word.encode()
        return _scanned(raw, ranks) if len(raw) <= SCAN_IDS else _heaped(raw, ranks)

    return _by_words(fold, keys[order], made[order], True, np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64))


def _scanned(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, len(ranks) + 1
    parts = [raw[i : i + 1] for i in range(len(raw))]
    pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _heaped(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same joins with a heap of the pairs that may be joined: n log n steps."""
    n = len(raw)
    to, before, joined = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)  # a part is raw[i:to[i]]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = to[i]
        if j < n and (rank := ranks.get(raw[i : to[j]])) is not None:
            heapq.heappush(heap, (rank, i, to[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = to[i]
        if joined[i] or j >= n or to[j] != end:
            continue
        joined[j], to[i] = 1, end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[raw[i : to[i]]] for i in range(n) if not joined[i]]


def vocabulary(merges: list[tuple[int, int]]) -> dict[int, bytes]:
    """Bytes of each id; special tokens have none."""
    vocab = {i: bytes([i]) for i in range(256)}
    for i, (a, b) in enumerate(merges):
        vocab[BASE + i] = vocab[a] + vocab[b]
    return vocab


def decoder(merges: list[tuple[int, int]]):
    """An Arrow function from ids to text: special and unknown ids are skipped, broken UTF-8 is replaced."""
    vocab = vocabulary(merges)
    pieces = [vocab.get(i, b"") for i in range(max(vocab) + 1)] + [b""]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    pool, begins = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes

    def texts(column: pa.ListArray) -> pa.Array:
        ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < len(pieces)), ids, len(pieces) - 1)
        n = sizes[ids]
        to = np.cumsum(n)
        content = pool[np.repeat(begins[ids] - (to - n), n) + np.arange(n.sum())].tobytes()
        rows = np.r_[0, to][np.r_[0, np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))]].tolist()
        return pa.array([content[i:j].decode("utf-8", "replace") if there else None for i, j, there in zip(rows, rows[1:], column.is_valid().to_pylist(), strict=False)], pa.string())

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        parts = [texts(column.slice(at, ROWS)) for at in range(0, len(column), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode


def offsets(docs: DataFrame, ids: str = "ids", position: str = "doc_id") -> DataFrame:
    """``docs`` with ``offset``: where the document's first token stands in the stream of all."""
    return running_sum(docs.withColumn("_n", F.size(ids).cast("long")), "_n", "offset", [position], exclusive=True).drop("_n")


def packed(docs: DataFrame, length: int, overlap: bool = False, ids: str = "ids", position: str = "doc_id") -> DataFrame:
    """seq_id, ids: full windows of ``length + 1`` tokens of the stream.

    Windows follow each other, or with ``overlap`` start every ``length`` tokens, so that the last token of one is the first of
    the next.  What is left at the end is dropped.
    """
    n, step = length + 1, length if overlap else length + 1
    t = offsets(docs.filter(F.size(ids) > 0), ids, position).select("offset", ids)
    last = F.col("offset") + F.size(ids) - 1
    # a document sends each window that it touches its own slice of tokens, not token by token
    low = F.when(F.col("offset") < n, F.lit(0)).otherwise(F.floor((F.col("offset") - n) / step) + 1)
    t = t.withColumn("seq_id", F.explode(F.sequence(low.cast("long"), F.floor(last / step).cast("long"))))
    a = F.greatest(F.col("seq_id") * step - F.col("offset"), F.lit(0))
    b = F.least(F.col("seq_id") * step + n - F.col("offset"), F.size(ids).cast("long"))
    t = t.select("seq_id", (F.col("offset") + a).alias("at"), F.slice(ids, (a + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = t.groupBy("seq_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return whole.filter(F.size("ids") == n)


def prepared(docs: DataFrame, encode, length: int, min_chars: int = 50, max_docs: int | None = None, text: str = "text", position: str = "doc_id") -> DataFrame:
    """seq_id, ids: training sequences of the first ``max_docs`` texts of at least 50 characters, encoded without marks and packed so that neighbours share a token.

    ``encode`` is a function from words to ids, such as an ``encoder``.  Short texts do not count for the cap; a cap of 0 or less lets none in.
    """
    kept = docs.filter(F.length(text) >= min_chars).select(position, text)
    if max_docs is not None:
        kept = first_rows(kept, max(max_docs, 0), position)
    # kept, as the offsets go over the ids several times
    return packed(saved(kept.select(position, encode(pretokens(F.col(text))).alias("ids"))), length, overlap=True, position=position)


def stats(docs: DataFrame, ids: str = "ids") -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("n_tokens"))
