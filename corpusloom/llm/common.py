"""Shared pieces: scratch tables in the shared folder, row-preserving Arrow maps, vectorised word splitting.

A *word* is a maximal run of characters other than space and U+0009-U+000D, so words never hold ASCII white space.
All helpers treat a null text as an empty one; callers that must tell them apart look at the validity themselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records in one Arrow batch sent to Python; Spark also ends a batch at spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20
#: Rows that annotate() works on at a time, and bytes of text after which a slice ends sooner.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20

#: What empties the caches that encoders keep in this worker; each encoder's module adds its own.
encoder_caches: list[Callable[[], None]] = []

_own_dir: str | None = None
#: Folders of Scratch tables that were made and not deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode where it is unset."""
    global _own_dir
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return "file://" + _own_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor only costs a re-read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom-{label}-{uuid.uuid4().hex}"
        _made.append(self.root)
        bounded_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it re-read."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        _delete(self.spark, [self.path(n) for n in names])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the Scratch tables made since `since` (0: all of this process), once what was built on them is stored.

    Results are lazy and read these tables, so operators cannot delete them themselves. Returns what to pass next time.
    """
    _delete(spark, _made[since:])
    del _made[since:]
    return len(_made)


def made() -> int:
    return len(_made)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so a Python worker's memory does not depend on how long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_array(column: pa.Array) -> pa.Array:
    """A string column without nulls, as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def forget_encoders() -> None:
    """Give back the caches of encoders: Spark reuses Python workers, so they would lie beside the next operator's memory."""
    for empty in encoder_caches:
        empty()


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of at most SLICE_ROWS rows and SLICE_BYTES of text, or of one longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield start, stop - start
        start, before = stop, int(ends[stop - 1])


def annotate(df: DataFrame, compute: Callable[[pa.Array, pa.Array], dict[str, pa.Array]], schema: str, key: str = "doc_id", text: str = "text", encodes: bool = False) -> DataFrame:
    """One row per input row: column `row` holds all input columns untouched, beside the columns that `compute` derives.

    compute gets the keys and the texts (nulls kept) of a batch. Because the input travels as one struct, its other
    columns may have any name and type. encodes: compute is an encoder, whose caches stay from task to task.
    """
    out = T.StructType([T.StructField("row", df.schema), *T._parse_datatype_string(schema).fields])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoders()
        for batch in batches:
            for k, size in slices(batch.column(2)):
                row, key_column, texts = (c.slice(k, size) for c in batch.columns)
                columns = compute(key_column, texts)
                yield pa.RecordBatch.from_arrays([row, *(columns[n] for n in names[1:])], names)
                pa.default_memory_pool().release_unused()

    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return packed.mapInArrow(run, out)


def unpack(annotated: DataFrame) -> DataFrame:
    """The input columns of annotate() again."""
    return annotated.select("row.*")


class Words:
    """The words of a batch: codes[offsets[i]:offsets[i+1]] are those of text i, as indices into `unique`."""

    def __init__(self, texts: pa.Array):
        listed = pc.ascii_split_whitespace(texts)
        flat = listed.flatten()
        full = np.asarray(pc.binary_length(flat)) > 0
        ends = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
        bounds = np.asarray(listed.offsets, dtype=np.int64) - listed.offsets[0].as_py() if len(listed) else np.zeros(1, np.int64)
        self.offsets = ends[bounds]
        coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.unique: pa.Array = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], 0 for empty slices."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 (the splitmix64 constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stable_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings that are the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(values))


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate pool[starts[i]:starts[i]+lengths[i]]."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def worker_threads_off() -> None:
    """Executors run one task per core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
