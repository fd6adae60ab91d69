"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of it and not a prefix.  A passage is encoded by the shares
of its bytes and some shape counts; a linear layer and tanh give its representation h.  Gated attention weighs the
passages, ``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and a logistic layer scores the sum of ``a h``.  Only
documents carry labels; the attention learns which passages decide.

Training takes at most ``SAMPLE`` labelled documents (those of least hash of the id), with all of their passages; the bound is
a parameter and holds for training only.  The executors encode, the driver trains on the encoded sample in batches of whole
documents, and the weights, a few kilobytes, go out with the function that scores every document.  Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import by_value, lean, settled, texts_of

PASSAGE = 64
SAMPLE = 6000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
#: Steps of training, whatever the size of the sample, and the documents that each looks at.
STEPS, DOCS = 800, 256
#: Passages that a step holds at most, unless a single document has more.
BATCH = 40_000
RATE = 0.01

_CLASS = np.zeros(256, np.int64)  # bytes above ASCII share two columns: those that lead a character and those that continue it
_CLASS[:128] = np.arange(128)
_CLASS[128:192] = 128
_CLASS[192:] = 129
_SHAPE = 6
FEATURES = 130 + _SHAPE
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def encode(text: bytes) -> np.ndarray:
    """One row of FEATURES for each passage of the whole text; a text without words has one row of zeros."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.append(True, space[:-1])) if len(data) else np.zeros(0, int)
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    of_word = np.arange(n) // PASSAGE
    count = int(of_word[-1]) + 1
    of_byte = np.repeat(np.arange(count), np.diff(np.append(starts[::PASSAGE], len(data))))
    body = data[starts[0] :]
    table = np.bincount(of_byte * 130 + _CLASS[body], minlength=count * 130).reshape(count, 130).astype(np.float32)
    size = table.sum(1, keepdims=True)
    words = np.bincount(of_word, minlength=count).astype(np.float32)
    out = np.zeros((count, FEATURES), np.float32)
    out[:, :130] = np.sqrt(table / np.maximum(size, 1))
    tokens = text.split()
    for i in range(count):
        part = tokens[i * PASSAGE : (i + 1) * PASSAGE]
        out[i, 130] = len(set(part)) / len(part)
    upper, lower = table[:, 65:91].sum(1), table[:, 97:123].sum(1)
    out[:, 131] = upper / np.maximum(upper + lower, 1)
    out[:, 132] = np.log1p(size[:, 0] / words) / 3
    out[:, 133] = table[:, 48:58].sum(1) / np.maximum(size[:, 0], 1)
    out[:, 134] = words / PASSAGE
    out[:, 135] = 1
    return out


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    """Passages x of bags that begin at ``starts``; ``bag`` numbers each passage's bag."""
    h = np.tanh(x @ w["E"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -60, 60)))}


def _batches(sizes: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Whole documents by number, pass after pass over all of them, each pass in an order of its own."""
    while True:
        order = rng.permutation(len(sizes))
        part = np.arange(len(order)) // DOCS + np.cumsum(sizes[order]) // BATCH
        yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 7, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights by Adam on the weighted log loss, over batches of documents, at a rate that falls to zero; the same rows give the same weights.

    One class only: weights whose score is near that class's label for any text; no rows: one half.
    """
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    w = {k: x.astype(np.float32) for k, x in w.items()}
    y = labels.astype(np.float32)
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if not len(y) or y.min() == y.max():
        w["b"][:] = 0 if not len(y) else (8 if y[0] else -8)
        return w | {"mean": mean, "scale": scale}
    # each document counts alike here too, whatever its length
    mean = np.mean([b.mean(0) for b in bags], 0)
    scale = np.maximum(np.sqrt(np.mean([((b - mean) ** 2).mean(0) for b in bags], 0)), 0.02)
    mean[-1], scale[-1] = 0, 1
    sizes = np.array([len(b) for b in bags])
    # both classes count alike at the threshold of 0.3 if the rarer one is weighted up in part
    weight = np.where(y == 1, 1.0, min(8.0, max(1.0, y.mean() / max(1 - y.mean(), 1e-9)) ** 0.5))
    weight = (weight / weight.mean()).astype(np.float32)
    m, v = {k: 0 for k in w}, {k: 0 for k in w}
    for step, rows in zip(range(steps), _batches(sizes, rng), strict=False):
        x = ((np.concatenate([bags[i] for i in rows]) - mean) / scale).astype(np.float32)
        starts, bag = np.cumsum(sizes[rows]) - sizes[rows], np.repeat(np.arange(len(rows)), sizes[rows])
        f = _forward(w, x, starts, bag)
        d = (f["p"] - y[rows]) * weight[rows] / len(rows)
        dz = d[:, None] * w["c"]
        h, a, t, g = f["h"], f["a"], f["t"], f["g"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
        grad = {"E": x.T @ (dh * (1 - h * h)), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}
        for k, q in grad.items():
            q = q + (decay * w[k] if k != "b" else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
            w[k] = (w[k] - RATE * (1 - step / steps) * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32)
    return w | {"mean": mean, "scale": scale}


def score(w: dict[str, np.ndarray], bags: list[np.ndarray]) -> np.ndarray:
    if not bags:
        return np.zeros(0)
    sizes = np.array([len(b) for b in bags])
    x = (np.concatenate(bags) - w["mean"]) / w["scale"]
    return _forward(w, np.clip(x, -20, 20), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes))["p"].astype(float)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Learns only from labelled rows whose CRC-32 of the id as text, modulo ``folds``, is not 0.

    * null or empty text: one passage of zeros, scored like any other.  A null id: as the empty text, held out.
    * a null label, or one with two values for an id: the row does not train.
    * no label to learn from: see ``train``.  Repeated rows are scored each; in training an id counts once, with the text of least hash.
    * empty table: no rows.  Other columns are ignored, whatever their names.
    """
    fold = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % folds
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    taught = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null").filter(fold(F.col("_id")) != 0)
    taught = taught.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most").drop("_most")
    # a bounded number of rows, so it may be broadcast
    taught = taught.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(text or b"").astype("<f4").tobytes() for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "bag", "label"])

    chosen = rows.join(F.broadcast(taught), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    encoded_rows = chosen.mapInArrow(lean(encoded), f"doc_id {rows.schema[0].dataType.simpleString()}, bag binary, label int")
    # at most ``sample`` ids, read by all cores at once and saved; they then come one partition at a time
    least = F.min(F.struct(F.xxhash64("bag").alias("h"), "bag", "label")).alias("x")
    found = settled(encoded_rows.groupBy("doc_id").agg(least).select("doc_id", "x.bag", "x.label"))
    rows_of = sorted(((r["doc_id"], r["bag"], r["label"]) for r in found.toLocalIterator()), key=lambda r: r[0])
    weights = train([np.frombuffer(bag, "<f4").reshape(-1, FEATURES) for _, bag, _ in rows_of], np.array([label for _, _, label in rows_of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                scores.append(score(weights, [encode(t or b"") for t in texts_of(batch.column(1).slice(at, 256))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    out = rows.mapInArrow(lean(run), f"doc_id {rows.schema[0].dataType.simpleString()}, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


by_value(__name__)
