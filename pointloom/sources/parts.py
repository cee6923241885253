"""Files written by many tasks: each encodes its rows to a part of its own, and the parts follow each other in one file."""

from __future__ import annotations

import os
import pickle
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Encodes a task's batches by write(bytes) and returns what the writer of the whole file needs to know of them.
Encoder = Callable[[Iterator[pa.RecordBatch], Callable[[bytes], None]], object]


def append_rows(rows: DataFrame, encode: Encoder, folder: str, out) -> list:
    """Encodes rows in parallel below folder, appends the parts to the file out in the partitions' order, and returns
    what encode returned for each. The folder, which must not exist and goes again, must be reached by all executors. A
    repeated attempt of a task writes a file of its own; only what the successful one names is read."""
    os.makedirs(folder)

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        name = f"{k:06d}-{uuid.uuid4().hex}"
        with open(f"{folder}/{name}", "wb") as file:
            told = encode((b for b in batches if b.num_rows), file.write)
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([name]), pa.array([pickle.dumps(told)])], names=["k", "name", "told"])

    try:
        written = rows.mapInArrow(run, "k long, name string, told binary").collect()  # a row for each partition
        for r in sorted(written, key=lambda r: r["k"]):
            with open(f"{folder}/{r['name']}", "rb") as own:
                shutil.copyfileobj(own, out, 1 << 24)
            os.unlink(f"{folder}/{r['name']}")
        return [pickle.loads(r["told"]) for r in written]
    finally:
        shutil.rmtree(folder, ignore_errors=True)
