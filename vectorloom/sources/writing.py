"""Sink of the tensor formats: tasks write raw parts beside the target, the commit joins them under one header.

Parts are named by attempt and only the attempts that Spark commits are joined, so a lost executor costs its own
parts and nothing is written twice. The commit copies bytes in blocks: its memory doesn't grow with the data. The
target's folder must be one that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from vectorloom.errors import AlreadyExists, InvalidArgument


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    rows: int
    dim: int | None


#: (tensor, rows, dim, ids or None) -> header bytes
Header = Callable[[str, int, int, "list[str] | None"], bytes]


class TensorWriter(DataSourceArrowWriter):
    """Rows (values[, id][, row]) as one tensor, in order of partition and of rows in it: sort first for another."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool, header: Header, half: bool, pad: int, keep_ids: bool):
        self.path, self.tensor = options["path"], options.get("tensor", "vectors")
        self.overwrite, self.header, self.half, self.pad = overwrite, header, half, pad
        self.keep_ids = keep_ids and "id" in schema.names
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        if "values" not in schema.names:
            raise InvalidArgument("a column values is needed")
        if os.path.exists(self.path) and not overwrite:
            raise AlreadyExists(self.path)
        os.makedirs(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        out = _Part(TaskContext.get().partitionId(), f"{self.folder}/{uuid.uuid4().hex}", 0, None)
        with open(out.path, "wb") as f, open(f"{out.path}.ids", "w", encoding="utf-8") as names:
            for b in iterator:
                if not b.num_rows:
                    continue
                column = b.column("values")
                lengths = set(np.diff(column.offsets.to_numpy()).tolist())
                flat = column.flatten()
                if column.null_count or flat.null_count or len(lengths) != 1 or out.dim not in (None, *lengths):
                    raise InvalidArgument("every row needs the same number of values, none null")
                out.dim, out.rows = lengths.pop(), out.rows + b.num_rows
                f.write(flat.to_numpy(zero_copy_only=False).astype("<f2" if self.half else "<f4").tobytes())
                if self.keep_ids:
                    ids = b.column("id").to_pylist()
                    if any(i is None or "\n" in i for i in ids):
                        raise InvalidArgument("ids are text without line ends")
                    names.writelines(f"{i}\n" for i in ids)
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        dims = {m.dim for m in parts}
        if len(dims) > 1:
            self.abort(messages)
            raise InvalidArgument("every row needs the same number of values, none null")
        ids = None
        if self.keep_ids:
            ids = []
            for m in parts:
                with open(f"{m.path}.ids", encoding="utf-8") as f:
                    ids += f.read().split("\n")[:-1]
        whole = f"{self.folder}/whole"
        with open(whole, "wb") as f:
            f.write(self.header(self.tensor, sum(m.rows for m in parts), dims.pop() if dims else 0, ids))
            start = f.tell()
            for m in parts:
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f, 1 << 20)
            f.write(b"\0" * (-(f.tell() - start) % self.pad))
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
