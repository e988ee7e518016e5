"""What the operators of this subpackage share: parked tables, checked lookups, text rules, word hashes."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.session import broadcast_rows, fits, shared_folder

#: White space of every word rule here: blank and the controls 9 to 13, nothing else of Unicode.
SPACE = "[\\x20\\x09-\\x0D]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/foreloom-llm-{name}-{uuid.uuid4().hex}"


def park(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._parked = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete parked tables whose readers are done."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._parked)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only for a side measured to be under the row limit of the session; meant for narrow rows."""
    return F.broadcast(df) if fits(df, broadcast_rows(df.sparkSession)) else df


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def normal_space(text: Column) -> Column:
    """Each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but white space), 0 for null."""
    t = F.trim(normal_space(text))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound; the hash does not depend on what is remembered."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers, so that every bit of a hash depends on every bit that went in."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 21):
    """Slices of a batch with a bounded amount of text, at least one row each."""
    at = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n or 0
    if at < len(batch):
        yield batch.slice(at)
