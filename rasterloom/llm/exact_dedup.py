"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of a text. A
batch is reduced to one row per digest, anti-joined with the index by
sort-merge (the index side is read bucket by bucket and is never shuffled), and
the digests that are new are appended under the batch's name. A batch that is run again under
its name, because its output was lost, appends nothing twice and gets the same verdicts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm.shared import shared_folder, written

SCHEMA = "digest binary, keep_id bigint, batch string"


class DigestIndex:
    """Digest index stored at ``path``; opening an existing path continues it.

    The number of buckets is kept beside the index; opening it with another one is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._layout(buckets)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _layout(self, wanted: int | None) -> int:
        side = f"{self.path.rstrip('/')}.layout"
        try:
            held = self.spark.read.schema("buckets int").parquet(side).first()
        except AnalysisException:
            held = None
        if held is None:
            buckets = wanted or max(16, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(side)
            return buckets
        if wanted not in (None, held.buckets):
            raise ValueError(f"the index at {self.path} has {held.buckets} buckets, not {wanted}")
        return held.buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch; one row per document, dropped ones too.

        ``batch`` names the batch. The index is changed before the result exists, so a batch whose
        output may get lost needs a name of its own: run again with the same rows under it,
        it gives the same result. Without one every call is a new batch.

        Returns ``doc_id, keep_id, group_size, kept, text_sha256``. A text that the
        index knows from another batch keeps that batch's row, so all its new
        copies are dropped. Of equal texts first seen in this batch the row with the
        largest id stays; ``group_size`` counts the batch's rows with that text.
        Null texts count as empty; a null id is smaller than any other. Rows that
        repeat an id and its text count each, and one of them stays. An empty batch
        gives no rows. Other columns of ``docs`` are ignored, whatever their names.
        """
        batch = batch or uuid.uuid4().hex
        rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
        )
        # equal rows meet here first, so no later step sees more than one of them
        rows = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        groups = written(
            rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("group_size")),
            "digest-groups",
        )
        fresh = groups.join(self.read(), "digest", "left_anti")
        (
            fresh.select("digest", F.col("top").alias("keep_id"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        # one row per digest, so the bucketed join is even; the join with the rows
        # below exchanges both sides, which lets adaptive execution split hot digests
        found = written(
            groups.join(self.read().withColumnRenamed("digest", "known"), F.col("digest") == F.col("known")).select(
                "digest", "keep_id", "group_size", (F.col("batch") == batch).alias("is_new")
            ),
            "digest-found",
        )
        return (
            rows.join(found, "digest")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate one relation by itself, through a fresh index."""
    return DigestIndex(docs.sparkSession, shared_folder(docs.sparkSession, "digest-index")).ingest(docs, id_col, text_col)
