"""Token counts by section: whole documents are encoded once, and their tokens joined to sections by place."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import raw, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public tokenizer cuts a text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Fixed value: what the pattern takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of so many characters are cut out before the pattern sees them: it goes back over a run step by step.
LONG_RUN = 20_000


def encoder(ranks: dict[bytes, int], least: int = LONG_RUN) -> Callable[[str], list[int]]:
    """Text to tokens, as the vocabulary's tokenizer has them.

    The pattern makes one piece of a run of white space, but for its last character where something follows; so a long
    run is merged as the one piece that it is, and the text before and behind it is encoded by itself.
    """
    import tiktoken

    encode, whole = (
        tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for name, pattern in (("own", PATTERN), ("piece", r"(?s).+"))
    )
    long = re.compile(f"[{WHITE}]{{{least},}}")

    def encoded(text: str) -> list[int]:
        at, out = 0, []
        for run in long.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += encode(text[at : run.start()]) + whole(text[run.start() : stop])
            at = stop
        return out + encode(text[at:]) if at else encode(text)

    return encoded


def shares(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """Tokens of every section, tokens of none, and tokens that touch several, from places in bytes.

    Token t covers ends[t-1] to ends[t]; sections are disjoint and in order.  A token that touches one section is that
    section's.  One that touches several goes, by rule ``largest``, to the one with the most of its bytes, the earlier
    of equals; by ``first`` to the earliest.  A token that touches none is outside.
    """
    count = np.zeros(len(starts), np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    low = np.searchsorted(stops, begins, "right")  # first section that ends after the token's begin
    high = np.searchsorted(starts, ends, "left")  # first section that starts at or after its end
    touched = np.maximum(high - low, 0)
    one = touched == 1
    np.add.at(count, low[one], 1)
    several = np.flatnonzero(touched > 1)
    for t in several:
        s = np.arange(low[t], high[t])
        size = np.minimum(stops[s], ends[t]) - np.maximum(starts[s], begins[t])
        # a section without bytes is touched by nothing
        pick = s[np.argmax(size)] if rule == "largest" else s[np.argmax(size > 0)]
        count[pick] += 1
    return count, int((touched == 0).sum()), len(several)


def attributed(docs: DataFrame, sections: Column | Callable, text: str = "text", vocabulary: str = VOCABULARY, rule: str = "largest") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_outside``, ``n_crossing`` and ``section_tokens`` in place of the text.

    ``sections`` is an array of (start, end) in characters of the text, end exclusive, disjoint and in order, or a
    function from a text to its starts and ends.
    Section tokens and those outside add up to all tokens.  Null text: no tokens.  Strings of special tokens are
    ordinary text.  The vocabulary is read on the driver and sent as one table of its own, fixed size.
    """
    if rule not in ("largest", "first"):
        raise ValueError(f"no such rule: {rule}")
    cut = None if isinstance(sections, Column) else sections
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"), (F.lit(None).cast("array<struct<start:int,end:int>>") if cut else sections).alias("_sections"))
    at = len(kept)
    new = [("n_tokens", pa.int64()), ("n_outside", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.int64()))]

    def run(batches):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        encode = encoder(ranks)
        for whole in batches:
            for part in slices(whole, at):
                out: list[list] = [[] for _ in new]
                for t, spans in zip(part.column(at).to_pylist(), part.column(at + 1)):
                    tokens = np.array(encode(t or ""), np.int64)
                    flat = spans.values
                    if cut:
                        starts, stops = cut(t or "")
                    elif flat is None:
                        starts = stops = np.zeros(0, np.int64)
                    else:
                        starts, stops = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    if not len(starts):
                        got = (np.zeros(0, np.int64), len(tokens), 0)
                    else:
                        body = np.frombuffer(raw(t), np.uint8)
                        if len(body) != len(t or ""):  # from characters to bytes
                            place = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
                            starts, stops = place[starts], place[stops]
                        got = shares(np.cumsum(sizes[tokens]), starts, stops, rule)
                    for column, value in zip(out, (len(tokens), got[1], got[2], got[0].tolist())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *[pa.array(v, k) for v, (_, k) in zip(out, new)]], schema=pa.schema([*list(part.schema)[:at], *[pa.field(n, k) for n, k in new]])
                )

    schema = rows.drop("_text", "_sections")
    for n, k in new:
        schema = schema.withColumn(n, F.lit(0).cast("long") if k == pa.int64() else F.array().cast("array<bigint>"))
    return rows.mapInArrow(run, schema.schema)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as sections, each with the line feed that ends it, so that they cover the text."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")])
    stops = np.minimum(np.cumsum(sizes), len(text))
    starts = np.concatenate([[0], stops[:-1]])
    # the last line of a text that ends in a line feed has no characters
    return starts[stops > starts], stops[stops > starts]


def by_line(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each line that has characters; null ids and repeated rows stay as they are, a row each."""
    return attributed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), line_sections, "text", vocabulary)


def digested(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id", "n_tokens", "n_outside", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), F.array_join(F.col("section_tokens").cast("array<string>"), ",").alias("section_tokens")
    )
