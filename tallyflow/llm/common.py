"""Pieces shared by the corpus operators: text folding, shared scratch tables, joins that survive hot keys."""

from __future__ import annotations

import functools
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in HOT_SHARE, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 10_000
#: What [\x20\x09-\x0D] matches.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. A text whose bytes and characters are as many is ASCII, where lower() does the same faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(col: Column) -> Column:
    """The maximal runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased; an array of one empty word if there are none."""
    return F.split(F.btrim(ascii_lower(F.coalesce(col.cast("string"), F.lit(""))), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")


def document_bucket(col: Column, modulus: int) -> Column:
    """crc32 of a document's id written as decimal text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset and all runs on one machine, a local folder becomes it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallyflow.scratch", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tallyflow-")
        spark.conf.set("spark.tallyflow.scratch", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: its lineage ends there and a lost executor costs no recomputation.
    The table goes with discard(), or at last when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    jvm.System.gc()  # the driver lets go of the shuffles that led here, and their files are deleted
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows join groups on key, where groups has one row for each key and size says how many of the total rows hold it.

    The keys that hold over one row in HOT_SHARE are at most HOT_SHARE, so they are broadcast whatever the input;
    the rows of all others are shuffled, and none of those keys can fill a task.
    """
    big = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = groups.where(big), groups.where(~big)
    other = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    first = marked.where(F.col("__hot")).drop("__hot")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot", *other).join(cold, key, how)
    return first.unionByName(rest.select(first.columns))


@functools.lru_cache(1)
def _malloc_trim():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Gives back what a Python worker has freed, so that workers side by side don't each keep their largest moment."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def text_chunks(batches: Iterator, text: str, limit: int = 6 << 20) -> Iterator:
    """Cuts Arrow batches into pieces of whole rows whose texts have at most limit bytes, or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                trim()
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
            if held > limit // 2:
                trim()
