"""Harmonic packing of texts into fixed-capacity token windows.

Lengths fall into reciprocal-capacity classes: class k holds lengths of
(capacity / (k + 1), capacity / k], and a window of class k takes exactly k of them.
Lengths up to capacity / TINY are laid end to end and cut at a stride that leaves
room for the last one. A row's window follows from its exact position in its class,
so every worker fills its windows alone.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.positions import with_positions
from quern.scratch import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"  # of the public vocabularies, or the path of another file
#: Pre-splitting of public byte-level BPE vocabularies: contractions, letters, digits, other marks, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TINY = 32


def _counter(raw: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        coder = tiktoken.Encoding("window", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), batch.column("mark")], names=["id", "tokens", "mark"])

    return run


def public_path(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens, mark): each row's whole text in tokens; mark is a hash of the text.

    Null and empty texts have 0 tokens. The vocabulary file (under 2 MB) is read on the
    driver and sent along.
    """
    with open(vocabulary if os.path.exists(vocabulary) else public_path(vocabulary), "rb") as f:
        raw = f.read()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    return rows.mapInArrow(_counter(raw, pattern), f"id {df.schema[id_col].dataType.simpleString()}, tokens long, mark long")


def pack(sizes: DataFrame, capacity: int, size_col: str = "tokens", tiny: int = TINY) -> DataFrame:
    """(id, piece, pieces, first, tokens, class, window) from (id, tokens, mark).

    An item larger than ``capacity`` is cut into full windows and a rest that is packed
    like other items; no other item is cut. Sizes of null, zero or less are in no window.
    Windows are named by class and number (class 0: the tiny ones); no window exceeds
    the capacity. Null ids and repeated rows are items of their own.
    """
    limit = capacity // tiny
    stride = capacity - limit + 1
    count = F.ceil(F.col("tokens") / F.lit(float(capacity))).cast("long")
    rows = sizes.select("id", F.col(size_col).cast("long").alias("tokens"), "mark").filter("tokens > 0")
    pieces = rows.withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces"))))
    first = (F.col("piece") - 1) * capacity
    parts = pieces.select("id", "mark", "piece", "pieces", first.alias("first"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - first).alias("tokens"))
    parts = parts.withColumn("class", F.when(F.col("tokens") <= limit, F.lit(0)).otherwise(F.floor(F.lit(capacity) / F.col("tokens"))).cast("int"))
    parts = parts.withColumn("step", F.when(F.col("class") == 0, F.col("tokens")).otherwise(F.lit(1).cast("long")))
    placed = with_positions(parts, ["class"], [F.col("id").asc(), F.col("mark").asc(), F.col("piece").asc()], out="upto", weight="step")
    number = F.when(F.col("class") == 0, F.floor((F.col("upto") - F.col("tokens")) / stride)).otherwise(F.floor((F.col("upto") - 1) / F.col("class")))
    return placed.select("id", "piece", "pieces", "first", "tokens", "class", F.concat_ws("-", "class", number.cast("long")).alias("window"))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token windows of the whole texts; see token_counts and pack. The counts are stored, so no text is tokenised twice."""
    return pack(cut(token_counts(df, id_col, text_col, vocabulary), "tokens"), capacity)


def large_texts(windows: DataFrame) -> DataFrame:
    """(doc_id) of the texts that had to be cut."""
    return windows.filter("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def window_fill(windows: DataFrame, capacity: int = 2048) -> DataFrame:
    """(class, windows, items, tokens, fill) per size class."""
    per = windows.groupBy("class", "window").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return per.groupBy("class").agg(F.count("*").alias("windows"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("fill"))
