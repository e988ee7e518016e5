"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import park
from foreloom.llm.prefix import numbered

WINDOW = 3


def windows(rows: DataFrame, text: str) -> DataFrame:
    """(_row, pos, last, key): the md5 of every run of three lines that is not blank throughout; a text of fewer lines is
    one run."""
    lines = F.split(F.col(text), "\n", -1)
    at = F.sequence(F.lit(0), F.greatest(F.size("_lines") - WINDOW, F.lit(0)))
    runs = F.transform(at, lambda i: F.array_join(F.slice("_lines", i + 1, WINDOW), "\n"))
    keyed = F.transform(runs, lambda r: F.when(r.rlike("[^\\x20\\x09-\\x0D]"), F.unhex(F.md5(r.cast("binary")))))
    out = rows.where(F.col(text).isNotNull()).select("_row", lines.alias("_lines"))
    out = out.select("_row", F.size("_lines").alias("_n"), F.posexplode(keyed).alias("pos", "key")).where(F.col("key").isNotNull())
    return out.select("_row", "pos", (F.least(F.col("pos") + WINDOW, F.col("_n")) - 1).alias("last"), "key")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``removed`` (line numbers from 0) and the text without them.

    A window that stands earlier, in order of (id, line), is a later occurrence; its lines go, and overlapping windows
    merge to passages.  Lines that the first occurrence of the same window holds are not covered by it, so a document
    that repeats itself keeps its first three lines.  Lines are compared as they are; a window of blank lines repeats
    nothing.

    Null text: no lines, stays null.  Empty text: one empty line.  Fewer than three lines: as it was.  Null ids come
    last; of repeated rows the first keeps its lines.  An empty table gives an empty result.
    """
    rows = numbered(docs, doc_id)
    held = park(windows(rows.select("_row", F.col(f"`{text}`").alias("_text_")), "_text_"), "windows")
    place = F.struct("_row", "pos")
    firsts = held.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = park(firsts.select(F.col("key").alias("_key"), F.col("first._row").alias("_row1"), F.col("first.pos").alias("_pos1")), "firsts")
    later = held.join(firsts, F.col("key") == F.col("_key")).where((F.col("_row") != F.col("_row1")) | (F.col("pos") != F.col("_pos1")))
    line = F.explode(F.sequence("pos", "last")).alias("line")
    covered = later.select("_row", "_row1", "_pos1", line)
    covered = covered.where((F.col("_row") != F.col("_row1")) | (F.col("line") >= F.col("_pos1") + WINDOW))
    gone = park(covered.groupBy("_row").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("_row", "_of"), "covered")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    none = F.array().cast("array<int>")
    # the same plan at every size: texts move once
    out = rows.join(gone.hint("merge"), F.col("_row") == F.col("_of"), "left").withColumn("_gone", F.coalesce("_gone", none)).withColumn("_lines", lines)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.size("_gone") == 0, F.col(f"`{text}`")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    )
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    count = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    return out.select(*columns, count.cast("long").alias("n_lines"), F.array_sort("_gone").alias("removed"))


def digested(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i AS pos, least(i + 3, len(l)) AS past, array_to_string(l[i + 1:i + 3], chr(10)) AS k
  FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 1))) AS i FROM d)),
o AS (
  SELECT doc_id, pos, past, first_value(doc_id) OVER s AS doc1, first_value(pos) OVER s AS pos1
  FROM w WHERE regexp_matches(k, '[^\x20\x09-\x0D]') WINDOW s AS (PARTITION BY k ORDER BY doc_id, pos)),
c AS (
  SELECT DISTINCT doc_id, line FROM (SELECT *, unnest(range(pos, past)) AS line FROM o WHERE doc_id <> doc1 OR pos <> pos1)
  WHERE doc_id <> doc1 OR line >= pos1 + 3),
x AS (SELECT doc_id, unnest(l) AS t, unnest(range(0, len(l))) AS line FROM d),
r AS (
  SELECT x.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
         sha256(coalesce(string_agg(t, chr(10) ORDER BY x.line) FILTER (c.line IS NULL), '')) AS text_sha256
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.line = c.line GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(text_sha256, sha256('')) AS text_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""
