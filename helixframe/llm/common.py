"""Helpers shared by the training-data operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+` words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Words of the license, shingle and scoring operators: every separator is ASCII, so the class is safe on UTF-8 bytes.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of text that become Python values at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session names none (tests) a folder of its own is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("helixframe.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("helixframe.shared.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that frees the shuffle files of a query once it is over.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, merge: bool = False) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: cuts lineage, survives lost executors. Its shuffle files are freed, since the table has the rows.

    With `merge` no join of `df` broadcasts a side unless told to: for sides that grow with the corpus, whatever their size today.
    """
    spark = df.sparkSession
    settings = {FREED: "true"} | ({"spark.sql.autoBroadcastJoinThreshold": "-1"} if merge else {})
    path, before = fresh_path(spark, label), {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a table that `stored` wrote and nothing needs any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, *texts: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and, but for one longer row, `size` bytes in the columns `texts`: only a part becomes Python values."""
    lengths = sum((pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in texts), np.zeros(batch.num_rows, np.int64))
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null: empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def by_rows(df: DataFrame, function: Callable[[list[list]], list[list]], schema: str, texts: tuple[int, ...] = (1,)) -> DataFrame:
    """Runs `function` on parts of few rows given as columns of Python values; it returns columns in `schema`'s order.

    A map over Arrow batches: no shuffle, memory bounded by `slices` over the columns `texts`, and a lost task is simply run again.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, *texts):
                columns = function([column.to_pylist() for column in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, parsed)


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)
