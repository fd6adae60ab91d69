"""Flat files of unsigned 16-bit tokens as a data source: ranges of bytes in parallel, a stream whose offset is a cursor, and a writer.

``spark.dataSource.register(FlatTokens)`` makes it ``format("flat_tokens")``.  The stream of tokens is that of all files one after the other, cut into sequences
of ``length`` ids; a sequence may lie over the end of a file, and what is left over at the end is no sequence.  Options:

* ``path``: a folder, or one file; anything that Arrow's file systems open (a URI) or a path that all executors see.
* ``length``: ids of a sequence, 1025 unless given.
* ``split``: sequences of a task, as many as 32 MB hold unless given.
* ``begin`` (batch): the first sequence to read; ``until`` (batch and stream): the sequence before which to stop.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from loomtext.session import carried

WIDTH = 2
INDEX = "_index.json"
#: Where written files lie, apart from files of others, so that only the index can name them.
PARTS = "parts"
#: Bytes of a task, and of what it holds at a time.
TASK, CHUNK = 32 << 20, 1 << 20


def opened(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


@dataclass
class Sequences(InputPartition):
    """Sequences ``low`` to ``high``; ``pieces`` are (file, first byte, bytes) that hold them, one after the other."""

    low: int
    high: int
    pieces: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    count: int


class Files:
    """The files of a path in their order, and where their tokens begin in the whole."""

    def __init__(self, path: str):
        self.fs, self.root = opened(path)
        info = self.fs.get_file_info(self.root)
        if info.type == stores.FileType.File:
            self.files = [(self.root, info.size // WIDTH)]
        else:
            self.files = [(f"{self.root}/{name}", count) for name, count in self.index()]
        self.ends = list(accumulate(count for _, count in self.files))

    def index(self) -> list[tuple[str, int]]:
        """What has been published; without an index, all ``.bin`` files by name."""
        at = f"{self.root}/{INDEX}"
        if self.fs.get_file_info(at).type == stores.FileType.File:
            with self.fs.open_input_stream(at) as f:
                return [tuple(x) for x in json.loads(f.read())]
        found = self.fs.get_file_info(stores.FileSelector(self.root, allow_not_found=True))
        return sorted((f.base_name, f.size // WIDTH) for f in found if f.type == stores.FileType.File and f.base_name.endswith(".bin"))

    def sequences(self, length: int) -> int:
        return (self.ends[-1] if self.ends else 0) // length

    def pieces(self, low: int, high: int) -> list[tuple[str, int, int]]:
        """Byte ranges of the tokens ``low`` to ``high`` of the whole."""
        out, i = [], bisect_right(self.ends, low)
        while low < high:
            name, count = self.files[i]
            begin = self.ends[i] - count
            to = min(high, self.ends[i])
            if to > low:
                out.append((name, (low - begin) * WIDTH, (to - low) * WIDTH))
            low, i = max(to, low), i + 1
        return out


class _Ranges:
    """Reading of sequences, for batch and stream."""

    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("length", 1025))
        if self.length < 1:
            raise ValueError("length must be one or more")
        self.split = max(1, int(options.get("split", TASK // (WIDTH * self.length))))
        self.begin, self.until = int(options.get("begin", 0)), options.get("until")

    def end(self, files: Files) -> int:
        n = files.sequences(self.length)
        return n if self.until is None else min(n, int(self.until))

    def ranges(self, files: Files, begin: int, end: int) -> list[Sequences]:
        cuts = range(begin, end, self.split)
        return [Sequences(a, min(a + self.split, end), files.pieces(a * self.length, min(a + self.split, end) * self.length)) for a in cuts]

    def read(self, partition: Sequences | None) -> Iterator[pa.RecordBatch]:
        """seq_id, ids.  A task holds ``CHUNK`` bytes and one sequence at a time, whatever its range."""
        if not isinstance(partition, Sequences):
            return
        fs, _ = opened(self.path)
        seq, held, size = partition.low, [], 0
        for name, first, n in partition.pieces:
            with fs.open_input_file(name) as f:
                for at in range(first, first + n, CHUNK):
                    held.append(f.read_at(min(CHUNK, first + n - at), at))
                    size += len(held[-1])
                    whole = size // (WIDTH * self.length)
                    if whole:
                        content = b"".join(held)
                        used = whole * WIDTH * self.length
                        yield self._batch(seq, whole, content[:used])
                        seq, held, size = seq + whole, [content[used:]], size - used

    def _batch(self, seq: int, whole: int, content: bytes) -> pa.RecordBatch:
        ids = pa.array(np.frombuffer(content, "<u2").astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1, dtype=np.int32) * self.length), ids)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(seq, seq + whole)), lists], names=["seq_id", "ids"])


class Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[Sequences]:
        files = Files(self.path)
        return self.ranges(files, self.begin, self.end(files)) or [InputPartition(None)]


class Stream(_Ranges, DataSourceStreamReader):
    """The offset is the number of sequences that have been read, counted from the first of all, so it means the same after any number of restarts."""

    def initialOffset(self) -> dict:
        return {"cursor": self.begin}

    def latestOffset(self) -> dict:
        return {"cursor": max(self.begin, self.end(Files(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Sequences]:
        return self.ranges(Files(self.path), start["cursor"], end["cursor"])


class Writer(DataSourceArrowWriter):
    """Rows' ids one after the other; a partition is a file, and files stand in the order of partitions.

    A file counts only once the index names it, which happens when all tasks are done, so attempts that failed or ran twice are never read; a failed write
    leaves the index as it was.  Appending adds to the index, or to the files that a folder without one holds; overwriting replaces it.  One write at a time.  A
    row whose array is null has no tokens; a null in an array, or an id that 16 bits do not hold, raises.
    """

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        if "ids" not in schema.fieldNames():
            raise ValueError("rows need a column ids, an array of int")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        partition = TaskContext.get().partitionId()
        name, count = f"{PARTS}/{partition:06d}-{uuid.uuid4().hex}.bin", 0
        fs.create_dir(f"{root}/{PARTS}", recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as f:
            for batch in iterator:
                ids = batch.column(batch.schema.get_field_index("ids")).flatten()
                if ids.null_count:
                    raise ValueError("a null is no token")
                n = ids.to_numpy()
                if len(n) and (n.min() < 0 or n.max() > 0xFFFF):
                    raise ValueError("ids must lie in 0 to 65535")
                f.write(n.astype("<u2").tobytes())
                count += len(n)
        return Written(partition, name, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        new = [(m.name, m.count) for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.count]
        files = new if self.overwrite else Files(self.path).index() + new
        staged = f"{root}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as f:
            f.write(json.dumps(files).encode())
        fs.move(staged, f"{root}/{INDEX}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "seq_id bigint, ids array<int>"

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


carried(__name__)
