"""Secret scans with a ledger of scanned blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.llm.common import folder, park


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``hint`` is a plain text that every match has; blobs without it are not searched.  A changed rule takes a new
    version, so that the ledger knows which blobs it has not seen.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values of the base kinds.  Runs of a class need no test of length after the match: a run that is long enough
# is matched from its first character, a shorter one not at all, so the least length stands in the pattern.
RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, base=True),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", hint="AKIA", base=True),
    Rule("hex", 1, "[0-9a-f]{16,}", base=True),
    # what the scan finds besides
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", hint="eyJ"),
    Rule("bearer", 1, "[Bb]earer\\x20+[A-Za-z0-9._~+/-]{20,}=*", hint="earer "),
)

SPAN = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: what lies between matches and the matches themselves give every place by running lengths."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(checked, lambda x: F.length(x)).alias("checked")
    )
    empty = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(F.lit(rule.kind).alias("kind"), at.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["checked"] >= rule.least, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda acc: acc["found"])
    there = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(there, found).otherwise(empty)


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind in the given order, joined by commas."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        F.filter(found, lambda x: F.array_contains(order, x["kind"])),
        lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("place"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("text")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["text"]), ",")


class Ledger:
    """Parquet table (blob, rule, found) at a path: what each rule version found in each blob, nothing included.

    A blob is the SHA-256 of a text.  One append records findings and the fact of the scan together, so a scan
    that was cut off is simply not in the ledger and is done again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(f"blob string, rule string, found {SPAN}").parquet(self.path)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the blobs of all versions for the rules that have not seen them, and record what was found."""
        body = F.coalesce(F.col(text), F.lit(""))
        blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
        ledger = self.read()
        if ledger is None:
            blobs = blobs.withColumn("_done", F.array().cast("array<string>"))
        else:
            keys = [r.key for r in rules]
            done = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("_done"))  # at most one entry a rule
            blobs = blobs.join(done, "blob", "left").withColumn("_done", F.coalesce("_done", F.array().cast("array<string>")))
            blobs = blobs.where(F.size("_done") < len(rules))
        entries = F.array(
            *[
                F.when(
                    ~F.array_contains("_done", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("_text"), r).alias("found"))
                )
                for r in rules
            ]
        )
        out = blobs.select("blob", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("_e")).select("blob", "_e.rule", "_e.found")
        out.write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """All columns of ``versions`` but the text, with ``found``: every span of every rule, for every path that has the blob."""
        body = F.coalesce(F.col(text), F.lit(""))
        others = [F.col(f"`{c}`") for c in versions.columns if c != text]
        paths = versions.select(*others, F.sha2(body, 256).alias("_blob"))
        ledger = self.read().where(F.col("rule").isin([r.key for r in rules]) & (F.size("found") > 0))
        # at most one row a rule and blob; blobs without a finding need no row here
        per_blob = park(ledger.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found")), "findings")
        out = paths.join(per_blob, paths["_blob"] == per_blob["blob"], "left")
        return out.select(*others, F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """Secrets of every document: (doc_id, found), on a ledger of its own unless one is given.

    Null text: the empty text, nothing found.  Repeated rows and equal texts under several ids: scanned once, a row
    each.  Null ids stay.  An empty table gives an empty result.  Other columns are not read.
    """
    ledger = ledger or Ledger(docs.sparkSession, folder(docs.sparkSession, "ledger"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text_"))
    ledger.scan(rows, "_text_", rules)
    return ledger.findings(rows, "_text_", rules)


def digested(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the spans of a scan."""
    base = tuple(r.kind for r in rules if r.base)
    counts = [F.size(F.expr(f"filter(found, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("found"), base), 256).alias("base_sha256"), joined(F.col("found"), tuple(r.kind for r in rules)).alias("spans")
    )


def _sql() -> str:
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
        ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    ]
    parts = [
        f"SELECT doc_id, {i} AS place, '{k}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, "
        f"regexp_extract_all(t, '{p}', {g}) AS checked FROM d"
        for i, (k, p, g, least) in enumerate(kinds)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
n AS (
  SELECT doc_id, place, kind, least, unnest(range(1, len(hits) + 1)) AS i, [length(x) FOR x IN gaps] AS g, [length(x) FOR x IN hits] AS h,
         [length(x) FOR x IN checked] AS c FROM m),
s AS (
  SELECT doc_id, place, kind, CAST(list_sum(g[1:i]) + coalesce(list_sum(h[1:i-1]), 0) AS BIGINT) AS a, CAST(list_sum(g[1:i]) + list_sum(h[1:i]) AS BIGINT) AS b
  FROM n WHERE c[i] >= least),
f AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


SQL = _sql()
