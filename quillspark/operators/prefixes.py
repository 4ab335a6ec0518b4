"""Shared prefixes of token sequences: the longest that a prompt has in common with a cache, the longest checkpoint that it begins with, the last place of a marker.

A prefix is known by its length and two rolling hashes of 64 bits, so prompts and cache meet by
equality and a prefix that all of them share is one row of the index. Rows grow with the tokens,
never with prompts times cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PREFIX = ["length", "one", "two"]
#: Tokens whose prefixes are made at once, if no sequence alone has more.
CHUNK_TOKENS = 1 << 17


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of CHUNK_TOKENS tokens or of one row."""
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, "right")))
            yield batch.slice(first, last - first)
            first = last


def _rolled(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of each row's tokens (hashes) every prefix, or the whole alone: its length and the sums of tokens times powers of two bases."""
    for batch in _chunks(batches):
        tokens = batch.column("tokens")
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        values = np.asarray(tokens.flatten()).astype(np.int64).view(np.uint64)
        place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
        out = []
        for base in _BASES:
            powers = np.full(int(sizes.max(initial=0)), base, np.uint64)
            if len(powers):
                powers[0] = 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(powers)[place])])
            out.append((sums[1:] - np.repeat(sums[ends - sizes], sizes)).view(np.int64))
        rows = ends[sizes > 0] - 1 if whole else np.arange(len(values))
        owner = np.repeat(np.arange(len(sizes)), sizes)[rows]
        columns = [batch.column("id").take(pa.array(owner)), pa.array(place[rows] + 1, pa.int64()), *(pa.array(x[rows]) for x in out)]
        yield pa.RecordBatch.from_arrays(columns, ["id", *_PREFIX])


def _prefixes(rows: DataFrame, id: str, tokens: str, whole: bool = False) -> DataFrame:
    """id and every prefix that isn't empty; a null token is a token of its own."""
    sent = rows.select(F.col(id).alias("id"), F.transform(tokens, lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("")), t.isNull())).alias("tokens"))
    return sent.mapInArrow(lambda it: _rolled(it, whole), f"id {sent.schema['id'].dataType.simpleString()}, length long, one long, two long")


def _longest(prompts: DataFrame, index: DataFrame, id: str, tokens: str, found: str) -> DataFrame:
    met = _prefixes(prompts, id, tokens).join(index, _PREFIX).groupBy(F.col("id").alias(id)).agg(F.max("length").alias("length"), F.max_by("first", "length").alias(found))
    return prompts.select(id).join(met, id, "left").fillna(0, ["length"])


def shared_prefix(prompts: DataFrame, cache: DataFrame, id: str, tokens: str) -> DataFrame:
    """id, length and cached: how many first tokens of each prompt some cached sequence begins with too, and the smallest id of these; 0 and null if none does.

    prompts and cache have id, unique among prompts, and an array of tokens.
    """
    index = _prefixes(cache, id, tokens).groupBy(*_PREFIX).agg(F.min("id").alias("first"))
    return _longest(prompts, index, id, tokens, "cached")


def longest_checkpoint(prompts: DataFrame, checkpoints: DataFrame, id: str, tokens: str, limit: int | None = None) -> DataFrame:
    """id, length and checkpoint: the longest sequence of checkpoints, of limit tokens at most, that the prompt begins with as a whole; of equal ones the smallest id."""
    if limit is not None:  # no longer prefix can be met
        checkpoints = checkpoints.where(F.size(tokens) <= limit)
        prompts = prompts.select(id, F.slice(tokens, 1, limit).alias(tokens))
    index = _prefixes(checkpoints, id, tokens, whole=True).groupBy(*_PREFIX).agg(F.min("id").alias("first"))
    return _longest(prompts, index, id, tokens, "checkpoint")


def last_marker(tokens: Column, marker: Column) -> Column:
    """How many tokens come before the last place where a marker stands in full; null if it stands nowhere, or is empty."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(marker) + 1, F.lit(1))), lambda i: F.slice(tokens, i, F.size(marker)) == marker)
    return F.when(F.size(marker) > 0, F.array_max(places) - 1)
