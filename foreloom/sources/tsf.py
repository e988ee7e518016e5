"""Series files: a header of @-lines, then one series per line ``a:b:...:v1,v2,?``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.plans.joins import attach
from foreloom.plans.ordered import running_sums

# Encoding of the files, and the format of dates in them.  Spark
# reads the Latin-1 superset; the characters in which the two differ are mapped.
ENCODING = "iso-8859-1"
FILE_ENCODING = "cp1252"
DATE_FORMAT = "yyyy-MM-dd HH-mm-ss"
TYPES = {"numeric": "int", "string": "string", "date": "timestamp_ntz"}


def _encoding_pairs() -> tuple[str, str]:
    """Characters that Latin-1 reads differently, and what the file means by them."""
    read, meant = "", ""
    for byte in range(0x80, 0xA0):
        try:
            meant += bytes([byte]).decode(FILE_ENCODING)
        except UnicodeDecodeError:
            continue
        read += chr(byte)
    return read, meant


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with their place: the file, where Spark's split of it starts, and a number that grows in the split.

    Places order the lines of any number of files, by the name of the file and then as they stand in it.
    """
    # one column of raw text: neither separator nor quote occurs in such files
    reader = spark.read.schema("line string").option("encoding", ENCODING)
    rows = reader.option("sep", "\u0001").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")
    )
    return rows.select(place.alias("place"), F.trim(F.translate("line", *_encoding_pairs())).alias("line")).where(F.col("line") != "")


# Header words of the format with the kind of what follows them, and the words for true and false.
HEADER_WORDS = {"frequency": str, "horizon": int, "missing": bool, "equallength": bool}
# Longest header that is read.
HEADER_LINES = 1_000
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")


class SeriesFileError(ValueError):
    """A series file that does not keep to the format."""


def _value(text: str, kind: type):
    if kind is not bool:
        return kind(text)
    if text.lower() not in TRUE_WORDS + FALSE_WORDS:
        raise SeriesFileError(f"{text!r} is neither a word for true nor for false")
    return text.lower() in TRUE_WORDS


def read_tsf_meta(spark: SparkSession, path: str) -> dict:
    """Header of a file: ``attributes`` (name to type, in order) and the header words that it has."""
    lines = _lines(spark, path)
    # header lines begin with an at sign; a handful of them, so that more are a sign of another kind of file
    header = [r["line"][1:].split() for r in lines.where(F.col("line").startswith("@")).orderBy("place").limit(HEADER_LINES + 1).collect()]
    if len(header) > HEADER_LINES:
        raise SeriesFileError(f"more than {HEADER_LINES} lines begin with an at sign")
    words = [h[0] if h else "" for h in header]
    attributes = [h[1:] for h in header if h and h[0] == "attribute"]
    bad = [a for a in attributes if len(a) != 2 or a[1] not in TYPES]
    if bad:
        raise SeriesFileError(f"attributes need a name and one of the types {sorted(TYPES)}: {bad}")
    if not attributes or "data" not in words or words.index("data") < words.index("attribute"):
        raise SeriesFileError("a header declares its attributes and then opens the data section")
    found = {h[0]: h[1:] for h in header if h and h[0] in HEADER_WORDS}
    loose = [k for k, v in found.items() if len(v) != 1]
    if loose:
        raise SeriesFileError(f"header words with one value each: {loose}")
    return {"attributes": dict(attributes), **{k: _value(v[0], HEADER_WORDS[k]) for k, v in found.items()}}


def _typed(field: Column, kind: str) -> Column:
    if kind == "date":
        return F.to_timestamp(field, DATE_FORMAT).cast("timestamp_ntz")
    return field.cast(TYPES[kind])


def read_tsf_series(
    spark: SparkSession, path: str, missing: float | None = None, meta: dict | None = None, strict: bool = False
) -> DataFrame:
    """One row per series: ``place``, the attributes with their types, ``series`` as doubles.

    ``?`` becomes ``missing``.  A wrong number of fields is an error; with
    ``strict`` a series of missing values only is one too.
    """
    meta = meta or read_tsf_meta(spark, path)
    names, kinds = list(meta["attributes"]), list(meta["attributes"].values())
    is_data = ~F.col("line").startswith("@") & ~F.col("line").startswith("#")
    lines = _lines(spark, path).where(is_data)
    parts = F.split("line", ":", -1)
    # the condition is repeated here because Spark may move the check below the filter
    wrong = F.raise_error(F.lit("a line has more or fewer fields than the header declares")).cast("array<string>")
    checked = F.when(F.size(parts) == len(names) + 1, parts).when(is_data, wrong)
    rows = lines.select("place", checked.alias("f"))
    text = F.split(F.col("f")[len(names)], ",", -1)
    value = F.transform(text, lambda v: F.when(v == "?", F.lit(missing).cast("double")).otherwise(v.cast("double")))
    if strict:
        empty = F.forall(text, lambda v: v == "?")
        value = F.when(empty, F.raise_error(F.lit("a series without any value")).cast("array<double>")).otherwise(value)
    typed = [_typed(F.col("f")[i], k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return rows.select("place", *typed, value.alias("series"))


def read_tsf_values(spark: SparkSession, path: str, missing: float | None = None) -> DataFrame:
    """Long form: attributes, time_index, global_index over all series, value.

    The global index adds the lengths of the series before; that running sum is
    over one number per series.
    """
    series = read_tsf_series(spark, path, missing)
    names = [c for c in series.columns if c not in ("place", "series")]
    sizes = series.select("place", F.size("series").cast("long").alias("n"))
    starts = running_sums(sizes, [], ["place"], {"upto": "n"})
    starts = starts.select("place", (F.col("upto") - F.col("n")).alias("start"))
    joined = attach(series, starts, ["place"])
    rows = joined.select(*names, "start", F.posexplode("series").alias("time_index", "value"))
    return rows.select(*names, "time_index", (F.col("start") + F.col("time_index")).alias("global_index"), "value")


def aligned(series: DataFrame, name: str = "series_name", start: str = "start_timestamp", place: str = "place") -> DataFrame:
    """Wide form of the series that share the most common start, cut to the shortest of them.

    ``series`` has a name, a start, a place and ``series``.  Among equally
    common starts the one seen first wins.  Rows are one minute apart.
    """
    starts = series.groupBy(start).agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"), F.min(F.size("series")).alias("length")
    )
    best = starts.orderBy(F.col("n").desc(), "seen").limit(1).select(F.col(start).alias("__start"), "length")
    chosen = series.join(F.broadcast(best), series[start] == F.col("__start"))
    rows = chosen.select(name, start, F.posexplode(F.slice("series", F.lit(1), F.col("length"))).alias("index", "value"))
    wide = rows.groupBy("index", start).pivot(name).agg(F.first("value"))
    stamp = F.col(start) + F.expr("INTERVAL 1 MINUTE") * F.col("index")
    others = [c for c in wide.columns if c not in ("index", start)]
    return wide.select("index", stamp.alias("timestamp"), *[F.col(f"`{c}`") for c in others])


def read_tsf_aligned(spark: SparkSession, path: str, missing: float | None = None) -> DataFrame:
    return aligned(read_tsf_series(spark, path, missing))
