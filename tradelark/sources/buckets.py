"""Tables stored in buckets of a key, and partitions of another column.

Tables bucketed alike meet on their key without an exchange. A bucketed table is Parquet
files in a folder plus an entry in the session catalog that says how they are laid out; the
entry is made anew in each session, the files stay.

Rows are sent straight to the task that writes their bucket. A key that holds a large part
of the rows is spread over several tasks there (``spread``), which costs as many files per
bucket. When such a table is opened and its largest bucket is far above the mean, it is
read without its buckets: one task per bucket would wait for that one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
# Bytes a bucket may have in any case, and above that how many times the mean.
EVEN_BYTES, EVEN_TIMES = 1 << 30, 4
# Bytes of raw input that make up a bucket.
BUCKET_BYTES = 256 << 20


@dataclass(frozen=True)
class Layout:
    """How a table is stored: buckets of ``key``, and folders of ``partition`` if given."""

    key: str
    buckets: int
    partition: str | None = None
    spread: int = 1

    def dealt(self, frame: DataFrame) -> DataFrame:
        """Each row in the task that writes its bucket, as Spark numbers buckets."""
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        if self.spread > 1:
            bucket = bucket * self.spread + F.pmod(F.xxhash64(*frame.columns), F.lit(self.spread)).cast("int")
        return frame.repartitionById(self.buckets * self.spread, bucket)

    def ordered(self, schema: T.StructType) -> list[T.StructField]:
        """The columns as they are stored: the partition column comes last."""
        return sorted(schema.fields, key=lambda field: field.name == self.partition)


def bucket_count(spark: SparkSession, paths: list[str], bytes_per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for tables made of these files: the same number for all, so that they meet."""
    total = 0
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += sum(status.getLen() if status.isFile() else files.getContentSummary(status.getPath()).getLength() for status in files.globStatus(path) or ())
    return max(1, -(-total // bytes_per_bucket))


def _table_name(path: str) -> str:
    return f"tradelark_{hashlib.md5(path.rstrip('/').encode()).hexdigest()[:20]}"


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_bucketed(
    frame: DataFrame, path: str, layout: Layout, *, last: Callable[[DataFrame], DataFrame] = lambda dealt: dealt
) -> DataFrame:
    """Write the table anew and return it as ``open_bucketed`` does.

    ``last`` sees the rows where they are written, after they were dealt to their buckets.
    """
    spark, schema = frame.sparkSession, frame.schema
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = last(layout.dealt(frame)).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.bucketBy(layout.buckets, layout.key).sortBy(layout.key)
    if layout.partition:
        writer = writer.partitionBy(layout.partition)
    # All of the table is replaced, whatever the session does with partitions.
    with _setting(spark, OVERWRITE, "static"):
        writer.saveAsTable(name)
    return _opened(spark, path, schema, layout)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, layout: Layout) -> DataFrame:
    """A table that was written with this schema and layout, maybe by another session."""
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"{_quoted(field.name)} {field.dataType.simpleString()}" for field in layout.ordered(schema))
    by = f"PARTITIONED BY ({_quoted(layout.partition)})" if layout.partition else ""
    key = _quoted(layout.key)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet {by} "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {layout.buckets} BUCKETS LOCATION '{place}'"
    )
    if layout.partition:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return _opened(spark, path, schema, layout)


def _opened(spark: SparkSession, path: str, schema: T.StructType, layout: Layout) -> DataFrame:
    if _even(bucket_sizes(spark, path)):
        return spark.table(_table_name(path))
    return spark.read.schema(T.StructType(layout.ordered(schema))).parquet(path)


def bucket_sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes per bucket, from the names of the files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    sizes: dict[int, int] = {}
    while listed.hasNext():
        status = listed.next()
        if found := re.search(r"_(\d{5,})(?:\.c\d+)?\.[^/]*parquet$", status.getPath().getName()):
            sizes[int(found[1])] = sizes.get(int(found[1]), 0) + status.getLen()
    return sizes


def _even(sizes: dict[int, int], least: int = EVEN_BYTES, times: int = EVEN_TIMES) -> bool:
    """Whether one task per bucket is a fair share of the work."""
    largest = max(sizes.values(), default=0)
    return largest <= least or largest * len(sizes) <= times * sum(sizes.values())


def replace_partitions(frame: DataFrame, path: str, layout: Layout) -> None:
    """Put the rows of ``frame`` in place of the partitions they fall into; others are not touched.

    The table must be open in this session.
    """
    if not layout.partition:
        raise ValueError("the table has no partitions")
    spark, name = frame.sparkSession, _table_name(path)
    stored = spark.table(name).columns
    with _setting(spark, OVERWRITE, "dynamic"):
        layout.dealt(frame.select(*stored)).write.mode("overwrite").insertInto(name)
    spark.catalog.refreshTable(name)
