"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.llm.common import discard, folder, normal_space, park, same

#: Buckets of an index; one made for 100 TB takes thousands.
BUCKETS = 48


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one blank; null is the empty text."""
    return F.sha2(normal_space(text), 256)


class DigestIndex:
    """Table (digest, keep_id, batch) at a path, one row per distinct text ever seen, with the batch that brought it.

    Bucketed and sorted by digest, so that a batch joins it without moving the index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "foreloom_digests_" + hashlib.md5(path.encode()).hexdigest()

    def open(self) -> DataFrame | None:
        """The bucketed table; None before the first append. A new session registers the files that are there."""
        if not self.spark.catalog.tableExists(self.table):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                return None
            kind = self.spark.read.parquet(self.path).schema["keep_id"].dataType.simpleString()
            self.spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id {kind}, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        fresh = fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        out = fresh.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
        out.mode("append").saveAsTable(self.table)

    def resolve(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Dedup a batch, append its new texts and return (doc_id, keep_id, group_size, kept, text_sha256), a row a document.

        The smallest id of equal texts stays unless the index has the text already; then none of the batch stays and
        keep_id is the one that the index has.  group_size counts the batch.  A batch that is run again under its name,
        say after a job was lost behind the append, gives the same answer: what it brought itself counts as new.  Null
        text: the empty text.  Null ids come after all others and stay only where nothing else has the text.  Of
        repeated rows (id and text equal) one stays.  An empty batch gives an empty result.
        """
        return self._answered(self.digested(docs, doc_id, text), batch)

    @staticmethod
    def digested(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc_id, digest, _row) of a batch, written once."""
        rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"))
        return park(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")

    def _answered(self, rows: DataFrame, batch: str | None) -> DataFrame:
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
        groups = rows.groupBy("digest").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.select(
            "digest", F.col("_first.doc_id").alias("keep_id"), F.col("_first._row").alias("_stays"), "group_size", F.lit(batch).cast("string").alias("batch")
        )
        groups = park(groups, "groups")
        index = self.open()
        if index is None:
            self.append(groups.limit(0))  # the table itself
            index = self.open()
        own = F.col("batch").isNotNull() & (F.col("batch") == F.lit(batch)) if batch is not None else F.lit(False)
        seen = index.where(~F.coalesce(own, F.lit(False))).select("digest", "keep_id").hint("merge")
        fresh = groups.join(seen, "digest", "left_anti")
        old = groups.drop("keep_id", "_stays").join(seen, "digest")
        old = old.select("digest", "keep_id", F.lit(None).cast("long").alias("_stays"), "group_size", "batch")
        answer = park(fresh.unionByName(old), "answer")
        fresh = answer.where("_stays IS NOT NULL")
        if batch is not None:
            fresh = fresh.join(index.where(own).select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh)
        answer = answer.select(F.col("digest").alias("_digest"), "keep_id", "_stays", "group_size")
        out = rows.join(answer, F.col("digest") == F.col("_digest"))
        kept = F.coalesce(F.col("_row") == F.col("_stays"), F.lit(False))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """``DigestIndex.resolve`` on an index of its own unless one is given.

    With several ``batches`` the table is cut by id into that many of about equal size, which come one after the other
    as new data would, null ids last; group_size then counts all of them.  The first batch is the one that meets an
    empty index.
    """
    index = index or DigestIndex(docs.sparkSession, folder(docs.sparkSession, "index"))
    if batches == 1:
        return index.resolve(docs, doc_id, text)
    rows = index.digested(docs, doc_id, text)
    # as many cuts as batches; where they fall changes the batches, not what stays
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    cuts = sorted(set(cuts))
    total = park(rows.groupBy(F.col("digest").alias("_of")).agg(F.count(F.lit(1)).alias("_total")), "totals")
    out = None
    for k in range(len(cuts) + 1):
        low = F.lit(True) if k == 0 else F.col("doc_id") > cuts[k - 1]
        part = rows.where(low & (F.col("doc_id") <= cuts[k])) if k < len(cuts) else rows.where(F.col("doc_id").isNull() | low)
        answer = park(index._answered(part, f"{index.table}-{k}"), "batch")
        out = answer if out is None else out.unionByName(answer)
    out = out.join(total.hint("merge"), F.col("text_sha256") == F.col("_of"))
    return out.select("doc_id", "keep_id", F.col("_total").alias("group_size"), "kept", "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with the columns they came with.

    Joined by (id, digest), which spreads the copies of one text, and so that ids used twice do no harm.
    """
    stay = dedup(docs, doc_id, text, index).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_digest_", digest(F.col(text)))
    out = marked.join(stay, same(F.col(doc_id), F.col("_id")) & (F.col("_digest_") == F.col("_sha")), "left_semi")
    return out.dropDuplicates([doc_id, "_digest_"]).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
