"""Near-duplicates by SimHash with an inverted index over positional bytes.

A fingerprint of B bytes within k differing bits of another agrees with it in at least B - k byte positions.  An
index entry is a set of positions with their bytes.  For 64 bits and k = 3 the sets are the 14 blocks of four
positions whose numbers XOR to zero: they form a Steiner system S(3, 4, 8), in which any three positions that differ
leave exactly one block whole, so no pair is missed, and an entry of 32 bits is rarely shared by chance (lists
of single bytes would hold 1/256 of the corpus each).  Rows of one entry are compared there: shared positional
bytes are counted, pairs below the guaranteed number are left, and the rest are verified bit by bit.

Equal fingerprints are one class from the start.  Within an entry, each class joins a growing tree and is
compared with those that are not yet in one, so an entry of m near copies yields m - 1 links instead of all pairs,
and components stay exact.  Entries above ``ENTRY`` rows are cut into chunks whose pairs are compared as tasks
of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import _starts, by_value, lean, runs, settled, texts_of
from loomtext.llm.components import components
from loomtext.llm.exact_dedup import _bitmap, _marked

#: Classes that are compared in one place; larger entries are compared chunk by chunk.
ENTRY = 20_000
SEED = 42


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles, repeats included; of the whole sequence if there are fewer words, of none without."""
    words = text.lower().split()  # bytes.lower changes A to Z only, bytes.split parts at space and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fold_bits(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """The fingerprint, 8 bytes a lane, highest byte first: a bit is 1 if set in over half of the hashes.

    The first lane takes the hashes as they are, each further one mixes them anew.
    """
    out = []
    for lane in range(lanes):
        h = hashes if not lane else _mixed(hashes, lane)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 32768):
            ones += np.unpackbits(h[i : i + 32768].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits((2 * ones > len(h))[::-1]).tobytes())
    return b"".join(out)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the binary ``fingerprint`` of each row; without words, all bits are zero. ``distinct`` counts a shingle once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for text in texts_of(batch.column(1)):
                h = shingle_hashes(text or b"", k)
                prints.append(fold_bits(np.unique(h) if distinct else h, lanes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema[0].dataType.simpleString()}, fingerprint binary")


def position_sets(size: int, most: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that fingerprints of ``size`` bytes within ``most`` bits agree on one at least.

    For 8 bytes and 3 bits, the 14 blocks of the module's docstring; else all pairs of neighbouring positions on a
    ring, which is a guarantee only up to ``size / 2 - 1`` bits and a high chance of a shared pair beyond.
    """
    if (size, most) == (8, 3):
        return [s for s in itertools.combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
    return [(i, (i + 1) % size) for i in range(size)]


def _entries(prints: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Entry keys of fingerprints (rows of bytes): one row per set, one column per fingerprint."""
    out = np.empty((len(sets), len(prints)), np.int64)
    for n, s in enumerate(sets):
        key = np.full(len(prints), n, np.int64)
        for p in s:
            key = key << 8 | prints[:, p]
        out[n] = key
    return out


def near(one: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Which of ``others`` lie within ``most`` bits of ``one``: first by counting shared bytes, then bit by bit."""
    shared = (others == one).sum(1) >= others.shape[1] - most if others.shape[1] > most else np.ones(len(others), bool)
    at = np.flatnonzero(shared)
    return at[np.bitwise_count(others[at] ^ one).sum(1, dtype=np.int64) <= most]


def trees(prints: np.ndarray, most: int, first: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join exactly the components of "within ``most`` bits" among the rows of ``prints``.

    With ``first``, only pairs of one of the first so many with one of the rest count.
    """
    links: list[tuple[int, int]] = []
    if first is None:
        rest = np.arange(len(prints))
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                hit = near(prints[i], prints[rest], most)
                if len(hit):
                    found = rest[hit].tolist()
                    links += [(i, j) for j in found]
                    queue += found
                    rest = np.delete(rest, hit)
        return links
    sides = [np.arange(first), np.arange(first, len(prints))]
    while len(sides[0]):
        queue = [(int(sides[0][0]), 0)]
        sides[0] = sides[0][1:]
        while queue:
            i, side = queue.pop()
            other = sides[1 - side]
            hit = near(prints[i], prints[other], most)
            if len(hit):
                found = other[hit].tolist()
                links += [(i, j) for j in found]
                queue += [(j, 1 - side) for j in found]
                sides[1 - side] = np.delete(other, hit)
    return links


class _Union:
    """Joins the links of a task, so that a task returns one link per node at most."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: bytes, b: bytes) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


_LINKS = "a binary, b binary, entry bigint, chunk int"


def _rows(a: list, b: list, entry: list, chunk: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(entry, pa.int64()), pa.array(chunk, pa.int32())], names=["a", "b", "entry", "chunk"])


def links(prints: DataFrame, size: int, most: int, entry_rows: int = ENTRY) -> DataFrame:
    """a, b: links that join the components of "within ``most`` bits" among distinct fingerprints (column fingerprint)."""
    sets = position_sets(size, most)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                column = batch.column(0)
                table = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)
                keys = _entries(table, sets)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.chunked_array([column] * len(sets)).combine_chunks().cast(pa.binary())], names=["entry", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, whole = _Union(), _Whole(entry_rows)
        for table in runs(batches, ["entry"], entry_rows):
            bounds = np.append(_starts(table, ["entry"]), table.num_rows)
            column, keys = table.column("fingerprint").combine_chunks(), table.column("entry").to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = int(keys[a])
                if b - a == 1 and key != whole.key:
                    continue
                members = column.slice(a, b - a).to_pylist()
                chunk = whole.chunk(key, len(members), a == 0)
                if chunk is not None:
                    yield _rows(members, [None] * len(members), [key] * len(members), [chunk] * len(members))
                    continue
                for i, j in trees(np.frombuffer(b"".join(members), np.uint8).reshape(-1, size), most):
                    union.join(members[i], members[j])
        nodes = list(union.up)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield _rows(part, [union.root(x) for x in part], [None] * len(part), [None] * len(part))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["entry", "low", "high"]):
            bounds = np.append(_starts(table, ["entry", "low", "high"]), table.num_rows)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
                members, chunk = part.column("a").to_pylist(), part.column("chunk").to_numpy()
                order = np.argsort(chunk, kind="stable")
                members = [members[i] for i in order]
                found = trees(np.frombuffer(b"".join(members), np.uint8).reshape(-1, size), most, None if low == high else int((chunk == low).sum()))
                if found:
                    yield _rows([members[i] for i, _ in found], [members[j] for _, j in found], [None] * len(found), [None] * len(found))

    rows = prints.select("fingerprint").mapInArrow(lean(spread), "entry bigint, fingerprint binary")
    rows = settled(rows.repartition("entry").sortWithinPartitions("entry").mapInArrow(lean(compare), _LINKS))
    found = rows.filter("b is not null").select("a", "b")
    large = rows.filter("b is null").select("a", "entry", "chunk")
    last = large.groupBy("entry").agg(F.max("chunk").alias("last"))
    if last.isEmpty():
        return found
    each = large.join(last, "entry").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    each = each.select("entry", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "a")
    dealt = each.repartition("entry", "low", "high").sortWithinPartitions("entry", "low", "high")
    return found.unionByName(dealt.mapInArrow(lean(pairs), _LINKS).select("a", "b"))


class _Whole:
    """Tells entries that came in one piece from those that are cut into chunks."""

    def __init__(self, most: int) -> None:
        self.most, self.key, self.next = most, None, 0

    def chunk(self, key: int, n: int, first: bool) -> int | None:
        """The number of this chunk, or None for an entry in one piece."""
        if not (n >= self.most or first and key == self.key):
            self.key = None
            return None
        if key != self.key:
            self.key, self.next = key, 0
        self.next += 1
        return self.next - 1


def grouped(docs: DataFrame, k: int = 3, most: int = 3, lanes: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text", entry_rows: int = ENTRY) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id for each row of ``docs``.

    Fingerprints link at ``most`` or fewer differing bits; component_id is the least doc_id that links reach.

    * null or empty text, or no words: fingerprint zero, linked like any other.
    * fewer than k words: the whole sequence is the one shingle.
    * rows that repeat an id: each is returned.  A null id never becomes a component_id unless all ids of it are null.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    """
    rows = settled(fingerprints(docs, k, lanes, distinct, id_col, text_col))
    classes = settled(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, 8 * lanes, most, entry_rows))
    joined = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    # classes without a link are their own components
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settled(joined.join(named, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


#: Frequent shingles that are known as such: they stand last in a document's order.  A bound on memory, no result depends on it.
HOT = 1 << 16


def _prefix(n: int) -> int:
    """How many of ``n`` shingles in a common order must hold one of another set's at a Jaccard similarity of 0.8."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _rarest(h: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``_prefix`` of a set's shingles (sorted by hash), frequent ones last; the order is the same for all sets."""
    n = _prefix(len(h))
    if not len(hot):
        return h[:n]
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    count = np.where(hot[at] == h, counts[at], 0)
    return h[np.lexsort((h, count))[:n]] if count[:n].any() else h[:n]


#: Bits of a parity sketch, and the size up to which a set has all its elements in one.
PARITY, WHOLE = 512, 400


def level(n: np.ndarray) -> np.ndarray:
    """0 below ``WHOLE`` elements, then one more at each doubling."""
    return np.maximum(0, np.frexp(np.asarray(n, np.float64) / WHOLE)[1])


def _sketch(h: np.ndarray, level: int) -> np.ndarray:
    """Bit i says whether an odd number of the hashes of a level fall to i; level l has those that end in l zero bits.

    Two sets differ in as many elements of a level at least as their sketches in bits.
    """
    if level:
        h = h[h & np.uint64((1 << level) - 1) == 0]
    return np.packbits((np.bincount((h >> np.uint64(20)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8))


def parity(h: np.ndarray) -> bytes:
    """Two sketches of a set of hashes: at its ``level`` and at the one below, that of even number first.

    Sets whose sizes are within 0.8 of each other are of one level or of neighbouring ones, so both have the lower of the two.
    """
    own = int(level(len(h)))
    two = [_sketch(h, own), _sketch(h, own - 1) if own else np.zeros(PARITY // 8, np.uint8)]
    return np.concatenate(two[:: 1 if own % 2 == 0 else -1]).tobytes()


def most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits the sketches of sets of a and b elements may differ in if their Jaccard similarity is 0.8 or more.

    At most a ninth of both sizes together are in one set only.  Level 0 has them all, so that the bound is exact; of a higher
    level, 7 standard deviations and 7 above its share of them.
    """
    low = np.minimum(level(a), level(b))
    share = (a + b) / 9 / (1 << low)
    return np.where(low == 0, share, share + 7 * np.sqrt(share) + 7)


class Candidates:
    """Nodes of one or more entries; which pairs of them may have a Jaccard similarity of 0.8.

    Three tests that no such pair fails: sizes within 0.8 of each other; parity sketches of the lower level at most ``most_apart``; and
    at most ``loose`` differing bits of the fingerprints, a count that is far off at 0.8 for sets of ``LARGE`` elements or more and that
    smaller sets are not put to.
    """

    LARGE = 64

    def __init__(self, table: pa.Table, loose: int):
        column = lambda name, size: np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64).reshape(-1, size)
        self.prints, self.n, self.loose = column("fingerprint", 1)[:, 0], table.column("n").to_numpy(), loose
        self.parity = column("parity", PARITY // 32).reshape(-1, 2, PARITY // 64)
        self.level = level(self.n)

    def __call__(self, i: np.ndarray | int, others: np.ndarray) -> np.ndarray:
        """Of ``others`` (numbers of rows) those that may be near ``i``: one row, or one for each of ``others``."""
        a, b = self.n[i], self.n[others]
        ok = (5 * b >= 4 * a) & (4 * b <= 5 * a)
        which = np.minimum(self.level[i], self.level[others]) % 2
        apart = np.bitwise_count(self.parity[others, which] ^ self.parity[i, which]).sum(1, dtype=np.int64)
        ok &= apart <= most_apart(a, b)
        return ok & ((np.minimum(a, b) < self.LARGE) | (np.bitwise_count(self.prints[others] ^ self.prints[i]) <= self.loose))

    def forest(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """Links that join exactly the components of the pairs that may be near."""
        out, rest = [], rows
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                hit = self(i, rest)
                if hit.any():
                    found = rest[hit].tolist()
                    out += [(i, j) for j in found]
                    queue += found
                    rest = rest[~hit]
        return out


def _entries_of(batches: Iterator[pa.RecordBatch], loose: int) -> Iterator[tuple[pa.Table, Candidates, np.ndarray, list[tuple[int, int]]]]:
    """Whole entries: their rows, which pairs may be near, the first rows of entries of two nodes, and (from, to) of larger ones.

    A set of nodes that a task has met in another entry is left out, as it would say the same again.
    """
    met: set[bytes] = set()
    for table in runs(batches, ["entry"]):
        bounds = np.append(_starts(table, ["entry"]), table.num_rows)
        nodes = table.column("node").to_pylist()
        twos, large = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                key = b"".join(nodes[a:b]) if b - a == 2 else xxhash.xxh3_128_digest(b"".join(nodes[a:b]))
                if key not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(key)
                    if b - a == 2:
                        twos.append(a)
                    else:
                        large.append((a, b))
        if twos or large:
            yield table, Candidates(table, loose), np.array(twos, np.int64), large


def _pairs(nodes: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([f(nodes[i], nodes[j]) for i, j in found] for f in (min, max))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def similar(docs: DataFrame, k: int = 5, loose: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, component_id, kept: rows linked where the Jaccard similarity of their sets of shingles is 0.8 or more.

    Postings are pairs (shingle, set) for the rarest fifth of each set's shingles: two sets at 0.8 always share one.  The
    order that says which are rarest is one for all sets, and any such order loses nothing; this one puts the frequent
    shingles last, so that a passage which many documents share does not bring them together.  Only postings whose shingle another
    set has go on, with a 64-bit fingerprint and a parity sketch by which ``Candidates`` tells pairs that may be near from
    others.  A forest of those is decided first, pair by pair, by the sets themselves; after that, each pair that may be near and
    that the forest's links have not joined.  So a large group takes links in proportion to its size.  Equal sets are one node
    from the start.

    ``text_key`` is the text's 64-bit hash; a row is told by its id and its text.  ``component_id`` is the least id of the group and
    ``kept`` marks the rows of that id (and least text_key, if the id has several texts in the group).

    * null texts and texts without words: the empty set, all alike.  Fewer than k words: the whole sequence is the one shingle.
    * rows that repeat an id: each by its own text.  A null id comes after all others.  Empty table: no rows.
    * other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return [np.unique(shingle_hashes(text or b"", k)) for text in texts_of(column)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "node", "fingerprint", "parity", "n", "times"]
        seen: dict[int, int] = {}

        def tally(sets: list[np.ndarray]) -> None:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= 4
            for v, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True):
                seen[v] = seen.get(v, 0) + c

        for batch in batches:
            sets = sets_of(batch.column(2))
            held = total = 0
            for i, h in enumerate(sets):
                total += len(h)
                if total > 4_000_000 or i == len(sets) - 1:
                    tally(sets[held : i + 1])
                    held, total = i + 1, 0
            nodes = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            prints, sketches, sizes = [fold_bits(h) for h in sets], [parity(h) for h in sets], [len(h) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
            id_type = batch.column(0).type
        # the most frequent shingles of this part of the corpus, as rows without a node
        top = sorted(seen.items(), key=lambda x: -x[1])[:HOT]
        if top:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(top), id_type), pa.array([v for v, _ in top], pa.int64()), *[pa.nulls(len(top), pa.binary())] * 3, pa.nulls(len(top), pa.int64()), pa.array([c for _, c in top], pa.int64())], names=names)

    read_ = settled(rows.mapInArrow(lean(read), f"doc_id {kind}, text_key bigint, node binary, fingerprint binary, parity binary, n bigint, times bigint"))
    # at most HOT rows
    top = read_.filter("node is null").groupBy("text_key").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "text_key").limit(HOT).collect()
    hot = np.array([r["text_key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, times = hot[order], np.array([r["times"] for r in top], np.int64)[order]
    rows_ = read_.filter("node is not null").drop("times")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    short = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")
    classes = settled(rows_.groupBy("node").agg(first, F.min("fingerprint").alias("fingerprint"), F.min("parity").alias("parity"), F.min("n").alias("n")).withColumn("short", short))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task posts a set once, however many copies it reads
        for batch in batches:
            entries, nodes = [], []
            for h in sets_of(batch.column(0)):
                node = int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "big") >> 4
                if node not in seen:
                    seen.add(node)
                    entries.append(_rarest(h, hot, times))
                    nodes.append(np.full(len(entries[-1]), node, np.int64))
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.concatenate(nodes))], names=["entry", "short"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings whose entry has another node, from sorted ones; one row is carried from batch to batch."""
        last, sent = np.zeros((0, 2), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([last, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]).any(1)
            x = x[new]
            same = x[1:, 0] == x[:-1, 0]
            shared = np.append(False, same) | np.append(same, False)
            out = shared.copy()
            if len(last):
                out[0] &= not sent
            sent = bool(shared[-1]) or sent and len(x) == 1
            last = x[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(x[out, 0]), pa.array(x[out, 1])], names=["entry", "short"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, near_by, twos, large in _entries_of(batches, loose):
            found = [(i, i + 1) for i in twos[near_by(twos, twos + 1)].tolist()] if len(twos) else []
            for a, b in large:
                found += near_by.forest(np.arange(a, b))
            yield _pairs(table.column("node").to_pylist(), found)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, near_by, twos, large in _entries_of(batches, loose):
            roots = table.column("root").to_pylist()
            found = [(i, i + 1) for i in (twos[near_by(twos, twos + 1)].tolist() if len(twos) else []) if roots[i] != roots[i + 1]]
            for a, b in large:
                number = np.unique(np.array([r.hex() for r in roots[a:b]]), return_inverse=True)[1]
                for i in range(a, b - 1) if number.max() else ():
                    other = i + 1 + np.flatnonzero(number[i + 1 - a :] != number[i - a])
                    if len(other):
                        found += [(i, j) for j in other[near_by(i, other)].tolist()]
            yield _pairs(table.column("node").to_pylist(), found)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("one", "two"))
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
            keep = [5 * n >= 4 * (len(x) + len(y) - n) for n, x, y in zip(common, a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    posted = rows.select("text").mapInArrow(lean(post), "entry bigint, short bigint").repartition("entry").sortWithinPartitions("entry", "short")
    shared = settled(posted.mapInArrow(lean(met), "entry bigint, short bigint"))
    dealt = lambda nodes, *more: shared.join(nodes, "short").select("entry", "node", "fingerprint", "parity", "n", *more).repartition("entry").sortWithinPartitions("entry", "node")
    found = settled(dealt(classes).mapInArrow(lean(grown), "a binary, b binary").distinct())

    # the sets of the nodes that an entry brings near another; a text stands for its node
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    near_by = classes.join(ends, "node", "left_semi")
    wanted = settled(near_by.select("node", F.col("least.text_key").alias("text_key")))
    bits = max(16, min(26, (64 * wanted.count()).bit_length()))
    marks = np.zeros(1 << bits, bool)
    # at most 2 ** 26 bits, so that the scan lets go texts that are not wanted without hashing or shuffling them
    slot = F.col("text_key").bitwiseAND(F.lit((1 << bits) - 1))
    for r in wanted.groupBy(F.floor(slot / 32768).alias("page")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect():
        marks[r["page"] * 32768 : (r["page"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[: len(marks) - r["page"] * 32768]
    packed = np.packbits(marks)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << bits) - 1)
            sets = sets_of(batch.column(1).filter(pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    sets = rows.select("text_key", "text").mapInArrow(lean(asked), "node binary, hashes binary")
    sets = settled(sets.groupBy("node").agg(F.min("hashes").alias("hashes")).join(wanted.select("node"), "node", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
        return settled(pairs.select("a", "b", "one", "two").mapInArrow(lean(agree), "a binary, b binary"))

    one = verified(found)
    rooted = classes.join(wanted.select("node"), "node", "left_semi").join(components(one), "node", "left").withColumn("root", F.coalesce("root", "node"))
    two = verified(dealt(rooted, "root").mapInArrow(lean(across), "a binary, b binary"))
    joined = classes.join(components(one.unionByName(two)), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("best"))
    named = settled(joined.join(named, "root").select("node", "best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return rows_.join(named, "node").select("doc_id", "text_key", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def without_copies(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``similar``: that of the least id, and of rows that repeat its id and text one.

    Rows are judged by their own texts, so a row whose id a copy has too stays.  Null and empty texts are one group.
    """
    own = docs.columns
    verdict = similar(docs, k, id_col=id_col, text_col=text_col).groupBy(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    verdict = settled(verdict.filter("not kept or n > 1"))
    # the table's own columns stand aside, as names may clash
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("doc_id"), key.alias("text_key"))
    # at most 2 ** 26 bits, by which rows without a verdict are let through unshuffled; a row that it takes for one of them meets none
    size = max(16, min(26, (64 * verdict.count()).bit_length()))
    rows = _marked(rows, "text_key", _bitmap(verdict, "of_key", "page", "bits", size), "page", "bits", "copy", size)
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    found = rows.filter("copy").join(verdict, same, "left").filter("kept is null or kept")
    alone, once = rows.filter("not copy"), found.filter("n is null or n = 1")
    again = found.filter("n > 1").dropDuplicates(["of", "of_key"])
    return alone.select("row").unionByName(once.select("row")).unionByName(again.select("row")).select(*[F.col("row").getField(c).alias(c) for c in own])


by_value(__name__)
