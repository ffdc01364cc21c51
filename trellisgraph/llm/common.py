"""Helpers shared by the corpus operators: shared storage, folds and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are handed to the numeric kernels in blocks of about this many UTF-8 bytes.
BLOCK_BYTES = 4 << 20
#: Rows of one Arrow batch, where the session has Spark's own 10,000: texts are long, and a batch is held whole.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Keys up to this number are broadcast to pick rows out of texts (16 MB); more are joined as Spark sees fit.
LISTED = 1 << 21
#: By module, what makes a worker process forget the things that its operator remembers from task to task.
FORGET: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``, else, in local mode only, one that is made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trellisgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing may read the frames afterwards."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by the hash of a key, and never over twice as many; the same ones on every run.

    Nothing is sorted and no task sends more than its share, however many partitions there are, unless keys repeat so often
    that more are chosen.
    """
    total = df.count()
    share = min(1.0, rows / max(total, 1))
    return at_most(df.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(share * (1 << 31))), 2 * rows)


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """All rows, or if there are more those with the least hashes of their values, so that every run takes the same ones."""
    if df.count() <= rows:
        return df
    return df.orderBy(F.xxhash64(*df.columns), *[F.hash(c) for c in df.columns[:1]]).limit(rows)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session says otherwise."""
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def picked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a written frame of distinct keys; texts are not shuffled while the keys are few."""
    return df.join(keys.hint("broadcast") if keys.count() <= LISTED else keys, key, "left_semi")


def wrapped(docs: DataFrame, *beside: str) -> DataFrame:
    """The rows as one struct ``doc``, so that no name within clashes with an operator's, and the columns named beside it.

    ``doc.*`` gives the rows back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[F.col(f"`{c}`").alias(c) for c in beside])


def give_back() -> None:
    """Return freed memory to the system, which the allocators of a waiting worker process would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def begin(owner: str) -> None:
    """Forget what operators of other modules remember in this process: workers serve one stage after the other."""
    for module, forget in FORGET.items():
        if module != owner:
            forget()


def as_task(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of a module for mapInArrow, so that a worker holds no more than what its present stage needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        yield from kernel(batches)
        give_back()

    return run


def per_text(
    df: DataFrame, schema: str, make: Callable[[], Callable[[list[bytes]], dict[str, list]]], keep: list[str], text_col: str = "text", binary: bool = False
) -> DataFrame:
    """Map whole texts (null: empty) to columns in Arrow batches, carrying the columns in ``keep``.

    ``make`` runs once per task and returns a function from a list of UTF-8 texts to new columns.
    Only ``keep`` and the text reach Python, so clashing extra columns cannot interfere.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(b"")) if binary else F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    kept = df.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"))
    out_schema = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(schema).fields])
    arrow_schema = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for block in blocks(batch):
                new = apply(block.column(len(keep)).to_pylist())
                columns = [block.column(i) for i in range(len(keep))] + [new[f.name] for f in list(arrow_schema)[len(keep):]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow_schema, strict=True)],
                    schema=arrow_schema,
                )

    return kept.mapInArrow(as_task(run, make.__module__), out_schema)


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch whose last column is the text into runs of about BLOCK_BYTES; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])
