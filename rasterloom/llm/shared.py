"""Words, shared folders and the registry of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words; every other character belongs to a word.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The folder of a local master that names none.
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A name for a fresh folder below ``spark.checkpoint.dir``.

    A local master without that setting gets one temporary folder; there the driver's disk is the shared disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corpus-", dir=os.environ.get("TMPDIR")))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a relation to the shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text without materialising anything but the split."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"[{SPACE}]+"))).cast("long")


def row_struct(docs: DataFrame) -> Column:
    """All columns of a relation in one, so that working columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def with_text(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with another text and its length."""
    return df.select(
        *[
            F.col(text).alias(c) if c == "text"
            else F.char_length(text).cast(t).alias(c) if c == "n_chars"
            else F.col("row")[c].alias(c)
            for c, t in docs.dtypes
        ]
    )


#: Stands for a null id wherever ids are compared: smaller than any other.
NO_ID = -(1 << 63)


def order_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def given_id(name: str = "d") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def discard(df: DataFrame) -> None:
    """Delete what ``written`` has written, once nothing will read it again."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver drop finished jobs, so that Spark's cleaner deletes their shuffle files now."""
    gc.collect()
    spark._jvm.System.gc()
