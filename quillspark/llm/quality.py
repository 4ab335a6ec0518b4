"""Quality rules: the log-likelihood ratio of a text's hashed n-grams between trusted texts and all texts.

Two multinomials over hashed byte n-grams are counted, one over the whole corpus and one over
trusted texts, to which a hundredth of the corpus is mixed, so an n-gram that they lack costs no
more than log(101). A text's score is the mean over its n-grams of the log ratio of the two, so it
doesn't depend on length, and a text is kept if the score reaches a threshold that is the same for
every document and every corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches
from quillspark.llm.words import CHUNK_BYTES, Chunk, buffers, chunks, mix, places, randoms, windows

NGRAM_BYTES = 3
BUCKETS = 1 << 16
#: Share of the corpus in the trusted model.
MIXED = 0.01
#: Nats per n-gram. Trusted texts lie near 0; text with a third of n-grams they lack below -0.7.
THRESHOLD = -0.5
#: Ids of trusted texts up to which each task gets them all; more meet the texts by a shuffle.
LISTED_IDS = 1_000_000
REPEAT_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

_U = np.uint64
_BYTE = randoms(256, 3)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngrams(data: np.ndarray, n: int = NGRAM_BYTES, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last n - 1."""
    if len(data) < n:
        return np.zeros(0, np.int32)
    if n <= 3:  # the n-gram itself is small enough to hash by one multiplication
        key = np.zeros(len(data) - n + 1, np.uint32)
        for j in range(n):
            key = (key << np.uint32(8)) | data[j : len(data) - n + 1 + j]
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)
    key = np.zeros(len(data) - n + 1, _U)
    for j in range(n):
        key = key * _U(0x9E3779B97F4A7C15) + _BYTE[data[j : len(data) - n + 1 + j]]
    return (mix(key) >> _U(65 - buckets.bit_length())).astype(np.int32)


def _spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n-gram of each text, and the one after its last."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        own = np.asarray(batch.column("own").to_numpy(zero_copy_only=False), bool)
        data, offsets = buffers(batch.column("text"))
        first = 0
        while first < len(own):
            last = min(len(own), max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1))
            lo, hi = _spans(offsets[first : last + 1] - offsets[first], n)
            f = ngrams(data[offsets[first] : offsets[last]], n)
            inside = np.zeros(len(f) + 1, np.int8)
            np.add.at(inside, lo[lo < hi], 1)
            np.add.at(inside, hi[lo < hi], -1)
            inside = np.cumsum(inside[:-1]) > 0
            every += np.bincount(f[inside], minlength=BUCKETS)
            for i in np.flatnonzero(own[first:last]):
                target += np.bincount(f[lo[i] : hi[i]], minlength=BUCKETS)
            first = last
    used = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(every[used]), pa.array(target[used])], names=["bucket", "every", "target"])


def ratios(docs: DataFrame, trusted: DataFrame, n: int = NGRAM_BYTES) -> np.ndarray:
    """The log ratio of each bucket. trusted: the doc_id of trusted documents; every text counts in the other model. Without trusted n-grams all are 0."""
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = ids.limit(LISTED_IDS + 1).count() <= LISTED_IDS
    ids = ids.withColumn("_own", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left")
    texts = texts.select("text", F.col("_own").isNotNull().alias("own"))
    counts = texts.mapInArrow(lambda it: _count(it, n), "bucket int, every bigint, target bigint")
    found = counts.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toArrow()
    every, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    every[np.asarray(found["bucket"])] = np.asarray(found["every"])
    target[np.asarray(found["bucket"])] = np.asarray(found["target"])
    return log_ratios(every, target)


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(every))
    p = every / every.sum()
    q = (1 - MIXED) * target / target.sum() + MIXED * p
    return np.log(np.divide(q, p, out=np.ones(len(p)), where=p > 0))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of them not for the first time."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def measures(c: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a chunk."""
    rows, data, n_words = c.rows, c.data, np.diff(c.bounds)
    out = {"n_words": n_words}
    inside = np.zeros(len(data) + 1, np.int64)
    starts_char = (data & 0xC0) != 0x80
    covered = np.zeros(len(data) + 1, np.int8)
    covered[c.starts] += 1
    covered[c.ends] -= 1
    np.cumsum(starts_char & (np.cumsum(covered[:-1]) > 0), out=inside[1:])
    out["word_chars"] = inside[c.offsets[1:]] - inside[c.offsets[:-1]]
    np.cumsum(_SYMBOL[data], out=inside[1:])
    out["n_symbols"] = inside[c.offsets[1:]] - inside[c.offsets[:-1]]

    # lines: cut at line feeds and at the texts' bounds
    cut = np.unique(np.concatenate([c.offsets[:-1][n_words > 0], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    dup = np.zeros(rows, np.int64)
    if len(cut):
        tail = data[cut[0] :]
        sizes = np.diff(np.append(cut, len(data)))
        value = np.where(tail == 10, _U(0), _BYTE[tail])
        value *= places(int(sizes.max()))[np.arange(len(tail)) - np.repeat(cut - cut[0], sizes)]
        text = np.searchsorted(c.offsets, cut, "right") - 1
        worded = np.searchsorted(c.starts, cut) < np.searchsorted(c.starts, np.append(cut[1:], len(data)))
        key = mix(np.add.reduceat(value, cut - cut[0])) + mix(text.astype(_U) + _U(99))
        _, later = _again(key[worded])
        dup += np.bincount(text[worded][later], minlength=rows)
    out["n_dup_lines"] = dup

    text = np.repeat(np.arange(rows), n_words)
    repeat = np.zeros(rows, np.int64)
    w = windows(c.hashes(), REPEAT_WORDS)
    if len(w):
        whole = text[: len(w)] == text[REPEAT_WORDS - 1 :]
        at = np.flatnonzero(whole)
        again, _ = _again(mix(w[at] + mix(text[at].astype(_U) + _U(7))))
        marks = np.zeros(len(text) + 1, np.int32)
        np.add.at(marks, at[again], 1)
        np.add.at(marks, at[again] + REPEAT_WORDS, -1)
        repeat += np.bincount(text[np.cumsum(marks[:-1]) > 0], minlength=rows)
    out["n_repeat_words"] = repeat
    return out


def _judge(batches: Iterator[pa.RecordBatch], table, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            m = measures(c)
            lo, hi = _spans(c.offsets, n)
            sums = np.append(0, np.cumsum(table.value[ngrams(c.data, n)]))
            hi = np.minimum(hi, len(sums) - 1)
            lo = np.minimum(lo, hi)
            m["score"] = (sums[hi] - sums[lo]) / np.maximum(1, hi - lo)
            m["base_failed"] = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
            m["kept"] = ~m["base_failed"] & (m["score"] >= threshold)
            rest = batch.slice(c.first, c.rows)
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(m[k]) for k in _JUDGED)], names=[*rest.schema.names, *_JUDGED])


_JUDGED = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "score": "double", "base_failed": "boolean", "kept": "boolean"}


def judge(docs: DataFrame, trusted: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, n: int = NGRAM_BYTES) -> DataFrame:
    """The columns named in keep, the measures of every text, its score, base_failed and kept.

    docs has doc_id (long) and text (string); a column of docs that is neither kept nor one of
    these is ignored, whatever its name. trusted has the doc_id of trusted documents. A null text
    counts as empty and fails the base rules; a text without n-grams scores 0; with no trusted
    documents every text does. An empty table gives no rows; repeated rows each keep theirs.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    table = spark.sparkContext.broadcast(ratios(docs, trusted, n))
    cols = [*keep, *(["text"] if "text" not in keep else [])]
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in cols)
    found = docs.select(*cols).mapInArrow(lambda it: _judge(it, table, n, threshold), fields + ", " + ", ".join(f"{k} {v}" for k, v in _JUDGED.items()))
    return found if "text" in keep else found.drop("text")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, trusted_ids(labels)).select("doc_id", *(k for k in _JUDGED))


def brute_force(texts: list[str | None], trusted: list[bool], threshold: float = THRESHOLD) -> list[tuple]:
    """The same by loops over strings, for tests."""
    import math

    def grams(t: str | None) -> list[int]:
        data = np.frombuffer((t or "").encode(), np.uint8)
        return [int(ngrams(data[i : i + NGRAM_BYTES])[0]) for i in range(len(data) - NGRAM_BYTES + 1)]

    all_grams = [grams(t) for t in texts]
    every = Counter(x for g in all_grams for x in g)
    target = Counter(x for g, own in zip(all_grams, trusted, strict=True) if own for x in g)
    all_n, target_n = sum(every.values()), sum(target.values())
    ratio = {x: math.log(((1 - MIXED) * target[x] / target_n + MIXED * n / all_n) / (n / all_n)) if target_n else 0.0 for x, n in every.items()}
    out = []
    for t, g in zip(texts, all_grams, strict=True):
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), (t or "").split("\n")
        win = Counter(tuple(w[i : i + REPEAT_WORDS]) for i in range(len(w) - REPEAT_WORDS + 1))
        hit = {i + j for i in range(len(w) - REPEAT_WORDS + 1) if win[tuple(w[i : i + REPEAT_WORDS])] > 1 for j in range(REPEAT_WORDS)}
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        score = sum(ratio[x] for x in g) / max(1, len(g))
        failed = len(w) < LEAST_WORDS or 100 * len(hit) > MOST_REPEATED_PERCENT * len(w)
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), failed, not failed and score >= threshold))
    return out
