"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word: space and U+0009 to U+000D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A word, for Java's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the cluster's shared checkpoint folder.

    A later failure reads the saved rows, so lost executors cost no recomputation of the lineage.  The folder is that of the context
    or else of the setting ``spark.checkpoint.dir``.  Without either, a session of one process (``local[...]``) gets a folder that goes when
    it ends; on a cluster this raises, as a folder of one machine would not do.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomtext-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def without_spaces(text: Column) -> Column:
    """``text`` without the characters of SPACES."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def by_value(name: str) -> None:
    """Ship the module's functions themselves to the executors, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, which gives its memory back to the system when a task ends.

    Spark keeps workers for later tasks, and what the allocators of idle ones hold counts against the executor.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return task


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from batches that are sorted by them.

    Holds one batch and one unfinished run at a time; with ``most``, a run that grows beyond it comes in pieces.
    """
    rest: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if rest:
            same = all(rest[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            first = starts[1] if len(starts) > 1 else batch.num_rows
            if same:
                rest.append(batch.slice(0, first))
                held += first
                batch = batch.slice(first)
                starts = starts[1:] - first
            if batch.num_rows or most and held >= most:
                yield pa.Table.from_batches(rest)
                rest, held = [], 0
        if batch.num_rows:
            last = int(starts[-1])
            if last:
                yield pa.Table.from_batches([batch.slice(0, last)])
            rest, held = [batch.slice(last)], batch.num_rows - last
    if rest:
        yield pa.Table.from_batches(rest)


def _starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


by_value(__name__)
