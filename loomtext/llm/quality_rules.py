"""Quality rules as weak supervision.

Each rule votes good or bad, or abstains.  A document counts only by its pattern of votes, of which there are at
most ``3 ** len(RULES)``; the counts of the patterns over all documents are sufficient for expectation-maximisation,
which estimates the share of good documents and, class by class, how often each rule votes which way.  The
posterior probability of the class good then decides, in place of a test that all rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import by_value, lean, settled, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_pipes")
#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?~^=+_@\\{}[]"
LEAST_WORDS = 50
#: From this posterior probability on a document is kept.
KEEP = 0.5


def counted(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text; words are parted by space and U+0009 to U+000D."""
    words = text.split()
    lines: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in lines:
                dup += bool(line.split())
            else:
                lines.add(line)
    points = len(text) - _has(text, TAIL) - _has(text, b" \t\n\x0b\x0c\r")
    upper = _has(text, UPPER)
    return (len(words), points, _has(text, SYMBOLS), dup, repeated(words), upper, upper + _has(text, LOWER), _has(text, MARKS), text.count(b"|"))


UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: The bytes that continue a character of UTF-8.
TAIL = bytes(range(0x80, 0xC0))


def _has(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def repeated(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words that occurs twice or more in the text, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:n]
    for i in range(1, window):
        _, code = np.unique(code * len(number) + ids[i : n + i], return_inverse=True)
    twice = (np.bincount(code) > 1)[code]
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i : n + i] |= twice
    return int(inside.sum())


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column for each of COUNTS (which replaces one of that name); null counts as the empty text."""
    rows = docs.drop(*COUNTS)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counted(t or b"") for t in texts_of(batch.column(at))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=[*batch.schema.names, *COUNTS])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """The rules: 1 for good, -1 for bad, 0 to abstain."""
    n, share = F.greatest("n_words", F.lit(1)), lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    mean = F.col("word_chars") / n
    upper = F.col("n_upper") / F.greatest("n_letters", F.lit(1))
    return [
        _vote(share("n_symbols") < 0.03, share("n_symbols") > 0.2),
        _vote(share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
        _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        _vote(mean.between(3.0, 6.5), (mean < 2.5) | (mean > 10.0)),
        _vote(upper < 0.15, upper > 0.35),
        _vote(share("n_marks") < 0.05, share("n_marks") > 0.2),
        _vote(share("n_pipes") < 0.02, share("n_pipes") > 0.1),
    ]


#: What is taken for a rule before any document is seen: how often its votes are bad and good on a good document, on
#: one that is bad in the rule's own way, and on one that is bad in another way.
ON_GOOD, ON_OWN, ON_OTHER = (0.02, 0.98), (0.98, 0.02), (0.15, 0.85)
EXPECTED_GOOD = 0.8
#: The weight of these expectations, as a share of the documents; it keeps the classes to their meaning.
PRIOR = 0.1


def posteriors(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The probability of good for each pattern of votes, by expectation-maximisation.

    A document is good or bad in the way of one rule, for bad documents seldom fail all rules at once.  Each of these
    classes has, for each rule that votes, a probability for each vote: the rule's accuracy on the class.  To abstain says
    nothing for or against a class.
    """
    rules = patterns.shape[1]
    hot = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # pattern, rule, vote
    expected = np.array([[ON_GOOD] * rules] + [[ON_OWN if i == j else ON_OTHER for j in range(rules)] for i in range(rules)])
    share = np.array([EXPECTED_GOOD] + [(1 - EXPECTED_GOOD) / rules] * rules)
    prior = PRIOR * weights.sum()
    p = np.zeros((len(patterns), rules + 1))
    for _ in range(rounds):
        q = p * weights[:, None]
        seen = np.einsum("pc,prv->crv", q, hot) + prior * share[:, None, None] * expected
        joint = np.log(q.sum(0) + prior * share) + np.einsum("prv,crv->pc", hot, np.log(seen / seen.sum(2, keepdims=True)))
        new = np.exp(joint - joint.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return new[:, 0]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, votes, posterior, base_failed, kept for each row of ``docs``.

    * null or empty text: no words, fails the base test.  A table of one pattern: its posterior is that of its votes.
    * empty table: no rows.  Repeated rows: one result each.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settled(counts(rows).drop("text").withColumn("votes", F.array(*votes())))
    return _verdicts(rows, rows).select("doc_id", *COUNTS, "votes", "posterior", "base_failed", "kept")


def _verdicts(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` with posterior, base_failed and kept, by expectation-maximisation over the votes of ``patterns``."""
    # at most 3 ** 7 patterns, however many documents
    seen = sorted((tuple(r["votes"]), r["count"]) for r in patterns.groupBy("votes").count().collect())
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = posteriors(np.array([v for v, _ in seen]), np.array([n for _, n in seen], float)) if seen else []
    found = rows.sparkSession.createDataFrame([(list(v), float(p)) for (v, _), p in zip(seen, good, strict=True)], "votes array<int>, posterior double")
    rows = rows.join(F.broadcast(found), "votes", "left").withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def passed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns; the rules run twice, so that no text is shuffled."""
    own = docs.columns
    patterns = counts(docs.select(F.col(text_col).cast("string").alias("text"))).select(F.array(*votes()).alias("votes"))
    # the table's own columns stand aside, as names may clash
    rows = counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text_col).cast("string").alias("text"))).drop("text")
    return _verdicts(rows.withColumn("votes", F.array(*votes())), patterns).filter("kept").select("row.*")


by_value(__name__)
