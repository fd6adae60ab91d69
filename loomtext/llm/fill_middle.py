"""Fill-in-middle: each text is cut at two ranks of its code points and laid out with sentinels.

The code points are told by the tokenizers library: a ``Split`` pre-tokenizer whose pattern matches one code point, with each match isolated,
gives the offsets of all of them without any training.  The length of that array of offsets is n, and the offsets at the two drawn
ranks are where the text is sliced.  A text is a row of words, and the offsets within a word are the same wherever it stands, so a
task asks the library once for each distinct word and adds up lengths; only the words that a cut falls into are asked for
offsets again.  The table of lengths is bounded, and a text is read in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import by_value, lean

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit: any code point, line ends included.
UNIT = r"(?m:.)"
_BLOCK, _WORD, _KNOWN = 1 << 20, 1024, 400_000  # code points of a block and of a word, words remembered


class Offsets:
    """Offsets of the units of texts by the library's pre-tokenizer."""

    def __init__(self, unit: str = UNIT) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(unit), "isolated")
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> list[int]:
        """Where each unit of ``piece`` begins."""
        return [start for _, (start, _) in self.split.pre_tokenize_str(piece)]

    def pieces(self, block: str) -> list[str]:
        """Words with the space that ends them, long ones in parts."""
        words = [w + " " for w in block.split(" ")]
        words[-1] = words[-1][:-1]
        if len(max(words, key=len)) <= _WORD:
            return words
        return [w[i : i + _WORD] for w in words for i in range(0, max(len(w), 1), _WORD)]

    def lengths(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.of(p))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, text: str) -> list[int]:
        """Units of each block of ``text``."""
        return [int(self.lengths(self.pieces(text[i : i + _BLOCK])).sum()) for i in range(0, len(text), _BLOCK)]

    def at(self, text: str, blocks: list[int], rank: int) -> int:
        """Where the unit of this rank (from 0) begins, in code points; the rank after the last one: the end."""
        for b, n in enumerate(blocks):
            if rank < n:
                pieces = self.pieces(text[b * _BLOCK : (b + 1) * _BLOCK])
                ends = np.cumsum(self.lengths(pieces))
                word = int(np.searchsorted(ends, rank, "right"))
                before = int(ends[word - 1]) if word else 0
                return b * _BLOCK + sum(map(len, pieces[:word])) + self.of(pieces[word])[rank - before]
            rank -= n
        return len(text)


def drawn(id_col: str, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers for a row: the first 8-digit groups of the SHA-256 of seed, colon, decimal id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, spm_rate: int = 20, seed: int = 1, unit: str = UNIT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    ``rate`` of a hundred texts are cut; of these ``spm_rate`` of a hundred put the suffix first (spm), the others the prefix (psm).
    What is drawn depends on ``seed`` and the id only, so reruns agree and rows that repeat an id draw alike.

    * null text: as the empty text, which is plain.  A text that holds a sentinel is plain too, as it could not be told apart.
    * null id: draws as an empty one.
    * very long text: read in blocks; whole.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), drawn(id_col, seed).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets(unit)
        for batch in batches:
            counts, forms, prefix, middle, output = [], [], [], [], []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blocks = offsets.count(text)
                n = sum(blocks)
                counts.append(n)
                if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                a, b = (offsets.at(text, blocks, r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                spm = h[3] % 100 < spm_rate
                forms.append("spm" if spm else "psm")
                prefix.append(a)
                middle.append(b - a)
                parts = (SUFFIX, text[b:], PREFIX, text[:a]) if spm else (PREFIX, text[:a], SUFFIX, text[b:])
                output.append("".join((*parts, MIDDLE, text[a:b])))
            numbers = (pa.array(c, pa.int64()) for c in (prefix, middle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), *numbers, pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(lean(cut), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from.

    A cut text holds no sentinel, and no sentinel can begin before the one that follows the first part and overlap it, so the first of
    each is the separator.
    """

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        a, rest = F.instr(body, second), lambda at, mark: F.substring(body, at + len(mark), F.lit(2**31 - 1))
        tail = rest(a, second)
        m = F.instr(tail, MIDDLE)
        return F.substring(body, F.lit(1), a - 1), F.substring(tail, F.lit(1), m - 1), F.substring(tail, m + len(MIDDLE), F.lit(2**31 - 1))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    s, p, m = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(p, m, s)).otherwise(F.col(output))


by_value(__name__)
