"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed word bigram model over all training documents, as an automaton.  State h stands for the word read
last.  It has an arc for each word seen after h in training, with the log-probability of that word, and one failure arc, taken
where no arc fits, to a state that knows only how often h occurs; that state's arcs reach every word of the vocabulary
and the unknown word.  Every arc for w ends in state w.  A text is traversed once from left to right: the state is carried
from token to token and the weights of the arcs taken are added up.  With c() the counts in training, b the size class of
c(h) and k that of c(w):

    arc of h for w           log10((1 - fail(b)) * c(h w) / c(h) + fail(b) * p(w | b))
    failure arc of h         log10(fail(b))
    arc of state b for w     log10(p(w | b)),   p(w | b) = share(k | b) * c(w) / C(k)

``fail(b)`` is the chance of a new successor.  If successors were independent of h it would follow from the unigram
counts alone, as would ``share``, the way in which new successors fall to the size classes; the
number of bigrams seen once, against what independence expects, scales it.  From each state the words of the vocabulary
and one unknown word (whose class has the mass of the words seen once) sum to one, the same events as the base.

Nothing of the model is gathered in one place.  Documents are packed to blocks of bounded size; a block sends the
hashes of its distinct words and bigrams with its own training counts to parts of the key space, the parts
add up and answer each block with the counts of what it asked for, and the block builds the states and arcs that its
texts can reach.  So requests and answers are in proportion to the corpus, and no task holds more than a block or a part.
Words are known by 64-bit hashes; bigrams by 40 bits within a part, whose number grows with the corpus, some 2 ** -20 of
them being taken for another of their part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import _starts, by_value, lean, runs, settled, texts_of

#: Bytes of text of a block, and bytes of corpus for each part of the key space.
BLOCK_BYTES = 14 << 20
PART_BYTES = 8 << 20
HELD_OUT = (7, 2)
CLASSES = 64
#: Tokens of a document that are read one after the other; longer ones are read in several lanes.
LANE = 256
END = b""  # no word is empty, so the end of a text (and its beginning, as a context) has this for a key


def held_out(doc_id: object, modulus: int, rest: int) -> bool:
    """By the CRC-32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == rest


def size_class(counts: np.ndarray) -> np.ndarray:
    """0 for 0, and 1 + floor(log2 c) else."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _pack(a: np.ndarray, kind: str) -> bytes:
    """Compressed by byte planes, as the upper bytes of most counts and word numbers are zero."""
    return zlib.compress(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"", 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Block:
    """The distinct words and bigrams of some documents, in the order in which the parts of the key space are asked."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, training: np.ndarray, bits: int):
        """tokens: numbers of words, each document ended by word 0, which is END; words: their hashes."""
        self.tokens, self.lengths = tokens, lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[:1] = 0  # the token before a document's first is the END of another, or END for the first
        self.pairs, pair_of = np.unique(before << 32 | tokens, return_inverse=True)
        taught = np.repeat(training, lengths).astype(np.float64)
        self.word_counts = np.bincount(tokens, taught, len(words)).astype(np.uint32)
        self.pair_counts = np.bincount(pair_of, taught, len(self.pairs)).astype(np.uint32)
        pairs = self.pairs
        with np.errstate(over="ignore"):
            keys = _mix(words[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + words[pairs & 0xFFFFFFFF])
        self.word_keys, self.pair_keys, self.bits = words, keys, bits
        self.word_order, self.pair_order = np.argsort(words, kind="stable"), np.argsort(keys, kind="stable")

    def requests(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(slot, keys, training counts): slots below 2 ** bits ask for words, the next as many for bigrams."""
        for base, keys, order, counts in ((0, self.word_keys, self.word_order, self.word_counts), (1 << self.bits, self.pair_keys, self.pair_order, self.pair_counts)):
            keys, counts = keys[order], counts[order]
            part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sent = keys[a:b].astype("<u8").tobytes() if not base else _narrow(keys[a:b], self.bits)
                yield base + int(part[a]), sent, _pack(counts[a:b], "<u4")

    def answered(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The corpus's training counts of the words and of the bigrams."""
        out = []
        for low, order in ((0, self.word_order), (1 << self.bits, self.pair_order)):
            slots = sorted(s for s in answers if low <= s < low + (1 << self.bits))
            values = np.concatenate([_unpack(answers[s], "<u4") for s in slots] or [np.zeros(0, np.uint32)])
            counts = np.empty(len(order), np.int64)
            counts[order] = values
            out.append(counts)
        return out[0], out[1]


def _narrow(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each key below those that name its part."""
    low = keys >> np.uint64(24 - bits) if bits <= 24 else keys
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(sent: bytes, words: bool) -> np.ndarray:
    if words:
        return np.frombuffer(sent, "<u8")
    out = np.zeros((len(sent) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(sent, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Weights:
    """The weights of the automaton that do not depend on the word itself."""

    def __init__(self, types: np.ndarray, tokens: np.ndarray, words_once: int, pairs_once: int):
        """types, tokens: of the vocabulary by size class."""
        self.n, self.v = int(tokens.sum()), int(types.sum())
        mass = tokens.astype(float).copy()
        mass[0] = max(words_once, 0.5)  # the unknown word has the mass of the words seen once
        mass /= mass.sum()
        typical = np.where(types > 0, tokens / np.maximum(types, 1), 0) / max(self.n, 1)
        context = np.where(types > 0, tokens / np.maximum(types, 1), np.exp2(np.arange(CLASSES) - 0.5))
        context[0] = 0
        fresh = mass[None, :] * np.exp(-context[:, None] * typical[None, :])  # class of h, class of w: new after so many successors
        chance = fresh.sum(1)
        once = float((tokens * np.interp(np.maximum(context - 1, 0), context, chance)).sum())
        self.fail = np.clip(chance * (pairs_once / once if once else 1.0), 1e-4, 1 - 1e-4)
        self.fail[0] = 1.0
        self.share = fresh / np.maximum(chance[:, None], 1e-300)
        self.total = np.maximum(tokens, 1).astype(float)


class Automaton:
    """The states and arcs that a block's texts can reach.

    States 0 to n - 1 are the block's words; a word that training does not have has no arcs and fails for nothing.  ``CLASSES`` further
    states are those to which failure arcs lead.  Their arcs, one for each word, are sums of two tables and are not laid out.
    """

    def __init__(self, weights: Weights, pairs: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """pairs: word before << 32 | word, ascending, with their training counts; words: training counts by number."""
        size = size_class(words)
        with np.errstate(divide="ignore"):
            self.below = np.log10(weights.share)  # of a failure state, by the class of the word
            self.within = np.log10(np.where(words > 0, words / weights.total[size], 1.0))  # of a word in its class
            self.failure = np.log10(weights.fail)[size]
        self.failure_to, self.word_class = size, size
        seen = counts > 0
        self.arcs = pairs[seen]  # state << 32 | word, ascending
        h, w = self.arcs >> 32, self.arcs & 0xFFFFFFFF
        b = size[h]
        own = counts[seen] / np.maximum(words[h], 1)
        lower = weights.share[b, size[w]] * np.where(words[w] > 0, words[w] / weights.total[size[w]], 1.0)
        self.weight = np.log10(np.maximum((1 - weights.fail[b]) * own + weights.fail[b] * lower, 1e-300))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states reached from ``state`` by ``word``, and the weights on the way: an arc's, or a failure arc's and one behind it."""
        weight = self.failure[state] + np.maximum(self.below[self.failure_to[state], self.word_class[word]] + self.within[word], -300.0)
        if len(self.arcs):
            key = state << 32 | word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            weight = np.where(self.arcs[at] == key, self.weight[at], weight)
        return word, weight

    def traverse(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The score of each document, all read at once from left to right.

        Long documents are read in lanes of ``LANE`` tokens; a lane begins in the state of the word before it, where the lane before ends.
        """
        ends = np.cumsum(lengths)
        lanes = -(-lengths // LANE)
        doc = np.repeat(np.arange(len(lengths)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = (ends - lengths)[doc] + nth * LANE
        left = np.minimum(LANE, ends[doc] - at)
        order = np.argsort(-left, kind="stable")
        doc, at, left, nth = doc[order], at[order], left[order], nth[order]
        state = np.where(nth > 0, tokens[np.maximum(at - 1, 0)], 0)
        score = np.zeros(len(doc))
        for i in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -i, side="left"))  # lanes with a token left
            state[:n], weight = self.step(state[:n], tokens[at[:n] + i])
            score[:n] += weight
        return np.bincount(doc, score, len(lengths))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = HELD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Learns from the documents whose CRC-32 of the id as text, modulo ``held[0]``, is not ``held[1]``; scores all.

    * null or empty text: one token, the end.  A null id: as the empty text, so it trains.
    * nothing to train on: every token is unknown.  Repeated rows train and are scored each.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(size // PART_BYTES).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        tokens: list[np.ndarray] = []
        number: dict[bytes, int] = {END: 0}
        held_bytes = serial = 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            values = [[part << 32 | serial], [ids], [lengths], [_pack(np.concatenate(tokens), "<u4")], [words.astype("<u8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "lengths", "tokens", "words"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = (text or b"").lower().split()  # bytes.lower changes A to Z only
                words.append(END)
                ids.append(doc_id)
                lengths.append(len(words))
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                held_bytes += len(text or b"") + 64
                if held_bytes >= block_bytes:
                    yield block()
                    serial += 1
                    ids, lengths, tokens, number, held_bytes = [], [], [], {END: 0}, 0
        if ids:
            yield block()

    blocks = settled(rows.mapInArrow(lean(pack), f"block bigint, ids array<{kind}>, lengths array<int>, tokens binary, words binary"))

    def opened(row: dict) -> Block:
        training = np.array([not held_out(i, *held) for i in row["ids"]], bool)
        tokens = _unpack(row["tokens"], "<u4").astype(np.int64)
        return Block(tokens, np.array(row["lengths"], np.int64), np.frombuffer(row["words"], "<u8"), training, bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                slots, keys, counts = zip(*opened(row).requests(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(slots), pa.int64()), pa.array(slots, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["block", "slot", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "slot", "counts", "class", "types", "tokens", "once"]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for table in runs(batches, ["slot"]):
            bounds = np.append(_starts(table, ["slot"]), table.num_rows).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(a, b - a)
                slot = part.column("slot")[0].as_py()
                words = slot < 1 << bits
                keys = [_wide(x, words) for x in part.column("keys").to_pylist()]
                own = np.concatenate([_unpack(x, "<u4") for x in part.column("counts").to_pylist()])
                _, of = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(of, own).astype(np.int64)
                cuts = np.cumsum([len(k) for k in keys])[:-1]
                out = [(blk, slot, _pack(x, "<u4"), None, None, None, None) for blk, x in zip(part.column("block").to_pylist(), np.split(total[of], cuts), strict=True)]
                size = size_class(total)
                for c in np.unique(size[total > 0]).tolist() if words else [0]:
                    these = total[size == c] if words else total
                    out.append((None, slot, None, c, len(these) if words else 0, int(these.sum()) if words else 0, int((these == 1).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    asked = blocks.select("block", "ids", "lengths", "tokens", "words").mapInArrow(lean(ask), "block bigint, slot int, keys binary, counts binary")
    answers = settled(asked.repartition("slot").sortWithinPartitions("slot").mapInArrow(lean(answer), "block bigint, slot int, counts binary, class int, types bigint, tokens bigint, once bigint"))

    # at most 64 size classes
    types, tokens, once = np.zeros(CLASSES), np.zeros(CLASSES), [0, 0]
    for r in answers.filter("block is null").groupBy((F.col("slot") < (1 << bits)).alias("w"), "class").agg(F.sum("types").alias("t"), F.sum("tokens").alias("n"), F.sum("once").alias("o")).collect():
        once[0 if r["w"] else 1] += r["o"]
        if r["w"]:
            types[r["class"]], tokens[r["class"]] = r["t"], r["n"]
    weights = Weights(types, tokens, once[0], once[1])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = opened(row)
                words, counts = block.answered({x["slot"]: x["counts"] for x in row["answers"]})
                own = words[block.tokens]
                starts = np.cumsum(block.lengths) - block.lengths
                known = np.add.reduceat((own > 0).astype(np.int64), starts)
                base = np.add.reduceat(np.log10((own + 1.0) / (weights.n + weights.v + 1.0)), starts)
                score = Automaton(weights, block.pairs, words, counts).traverse(block.tokens, block.lengths)
                out = [[held_out(i, *held) for i in row["ids"]], row["lengths"], known, [weights.n] * len(known), base, score]
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("ids"))[at].values, *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    got = answers.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("slot", "counts")).alias("answers"))
    return blocks.join(got, "block").mapInArrow(lean(traverse), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


by_value(__name__)
