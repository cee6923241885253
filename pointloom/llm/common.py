"""What the operators share: the folder for cut lineage, Arrow batches as byte arrays, and packed shards of texts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a null doc_id inside packed arrays: smaller than every other.
NULL_ID = np.iinfo(np.int64).min
#: Bytes of text in a packed shard, but for a single longer text: the least and the most, and between them a share of
#: the table, since what tasks send each other has a row for each shard and group.
SHARD_BYTES, MOST_SHARD_BYTES, SHARDS = 4 << 20, 64 << 20, 16_384
#: Characters that words cannot hold, for Java's and for RE2's regular expressions.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. Where that is unset, a temporary one if
    this is the only machine, else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_by(df: DataFrame, key: str) -> DataFrame:
    """checkpoint(df), dealt out by a column in a way that later joins on it know of: they do not move it again.
    An adaptive plan does not say how its result is dealt out, so this one is planned as a whole."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpoint(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set(name, before)


#: What moves rows: a plan with any of these is not asked for its partitions, which could run it.
MOVING = ("Aggregate", "Join", "Sort", "Window", "Repartition", "Distinct", "Union", "Limit")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it is read in fewer parts than there are cores, as a small file is; else as it is."""
    execution = df._jdf.queryExecution()
    plan = execution.optimizedPlan().toString()
    if any(f"{x} " in plan or f"{x}[" in plan for x in MOVING):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if execution.toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n; a null counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z and nothing else. Spark's lower() does so for ASCII texts, and quicker than translate()."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words_of(col: Column) -> Column:
    """The words of a text, lower-cased: an array, empty for a null text."""
    bare = F.regexp_replace(lower_ascii(F.coalesce(col, F.lit(""))), "^" + NOT_WORD, "")
    return F.filter(F.split(bare, NOT_WORD), lambda w: w != "")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, without a copy; a null is an empty value."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def ids_of(col: pa.Array) -> np.ndarray:
    return col.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


@dataclass
class Shard:
    """Some texts one after another. off: where each begins in data; null: which texts are null."""

    ids: np.ndarray
    null: np.ndarray
    off: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def row(self) -> list[bytes]:
        lens = np.where(self.null, -1, np.diff(self.off))
        return [zstandard.ZstdCompressor(level=3).compress(x) for x in (self.ids.tobytes(), lens.astype(np.int64).tobytes(), self.data.tobytes())]

    @staticmethod
    def of_row(ids: bytes, lens: bytes, data: bytes) -> Shard:
        ids, lens, data = (zstandard.ZstdDecompressor().decompress(bytes(x)) for x in (ids, lens, data))
        n = np.frombuffer(lens, np.int64)
        return Shard(np.frombuffer(ids, np.int64), n < 0, np.concatenate([[0], np.cumsum(np.maximum(n, 0))]), np.frombuffer(data, np.uint8))


def shards_in(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[Shard]:
    """The texts of batches with columns id and text, in shards of about `most` bytes."""
    for b in batches:
        ids, (off, data) = ids_of(b.column(0)), buffers(b.column(1))
        null = np.asarray(b.column(1).is_null(), dtype=bool)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
            yield Shard(ids[lo:hi], null[lo:hi], off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]])
            lo = hi


SHARD_SCHEMA = "shard long, n_docs long, n_bytes long, ids binary, lens binary, data binary, rest binary"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_on: tuple[str, ...] = (), least: int = SHARD_BYTES) -> DataFrame:
    """Texts as compressed shards in the shared folder, SHARD_SCHEMA. A shard's number is fixed when it is written;
    rest has the columns pass_on of its rows, as an Arrow stream. Shards are dealt out by their numbers before they are
    written, so that later joins by number need not move them. Their size follows the plan's estimate of the table's,
    within least and MOST_SHARD_BYTES; results do not depend on it."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(least, min(MOST_SHARD_BYTES, estimate // SHARDS))

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            lo = 0
            for s in shards_in(iter([b]), most):
                sink = pa.BufferOutputStream()
                own = b.select(b.schema.names[2:]).slice(lo, len(s)) if pass_on else None
                if own is not None:
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(own)
                lo += len(s)
                row = [base + k, len(s), len(s.data), *s.row(), sink.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "n_docs", "n_bytes", "ids", "lens", "data", "rest"])
                k += 1

    df = spread(df)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(df[c].alias(f"c{k}") for k, c in enumerate(pass_on))]
    return checkpoint_by(df.select(*columns).mapInArrow(run, SHARD_SCHEMA), "shard")


def rest_of(rest: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(rest).read_next_batch().columns if rest else []


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Shard]]:
    """Each row of batches that have the columns of SHARD_SCHEMA, with its other columns, and its shard."""
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in b.schema.names}
            yield row, Shard.of_row(row.pop("ids"), row.pop("lens"), row.pop("data"))
            pa.default_memory_pool().release_unused()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
