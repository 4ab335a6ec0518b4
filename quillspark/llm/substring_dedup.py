"""Substring dedup: repeated windows of tokens are found by counted Rabin-Karp hashes and removed.

Every window of ``size`` words of every text gets two rolling hashes, of 64 and of 24 bits. A
batch of texts sends each of its distinct windows once to Spark's shuffle, packed by ranges of
the first hash, so a passage that a third of all texts share leaves a batch once. A range is a
partition and a group of about RANGE_WINDOWS windows at any size of the input; there the
occurrences of each window are counted over all batches. What travels back is one bit for each
window that was sent, in the order of its text's sorted windows. A document's repeated windows
are merged into maximal intervals, whose words go.

Two windows count as the same if both hashes agree, 88 bits: among n windows n * n / 2**89 pairs
of different ones are expected to agree by chance, 0.16 for ten trillion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches
from quillspark.llm.words import chunks, windows

WINDOW_WORDS = 35
#: Windows of a range of the hash on average: what one task counts at a time.
RANGE_WINDOWS = 1 << 22
LEAST_RANGES = 8
#: Bytes of text for a window, to tell the number of ranges.
WINDOW_BYTES = 6
#: Texts that are numbered together at most, whatever the batches hold; a number has 16 bits.
MOST_OWNERS = 1 << 15
#: Base of the second hash.
CHECK_BASE = 0xD6E8FEB86659FD93

_SENT = "range int, batch bigint, owners binary, counts binary, hashes binary, checks binary, keys binary"
_BACK = "range int, batch bigint, owners binary, counts binary, hashes binary, checks binary, keys binary"


def _hashed(words: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of every window; the first with all but its highest bits cleared, for tests."""
    first, second = windows(words, size), windows(words, size, CHECK_BASE) >> np.uint64(40)
    return first if bits == 64 else first >> np.uint64(64 - bits) << np.uint64(64 - bits), second.astype(np.uint32)


def _sorted(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by both hashes, stable, and whether each, in that order, is the same as the one before."""
    order = np.argsort(h, kind="stable")
    same = np.append(False, h[order[1:]] == h[order[:-1]])[: len(order)]
    if np.any(same[1:] & (c[order[1:]] != c[order[:-1]])):  # else the first hash alone has brought the same together
        order = np.lexsort((c, h))
        same = np.append(False, (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]]))[: len(order)]
    return order, same


def _send(batches: Iterator[pa.RecordBatch], size: int, ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Of each batch a row with its texts' keys and what repeats within it, and its windows by ranges of the hash.

    owners: places of texts in the batch; counts: how many of the hashes come from each. Of
    windows that repeat within the batch the first text that has one sends it. The row with the
    keys has a bit for each distinct window of each text: in hashes whether it repeats within
    the batch, in checks whether its text sends it.
    """
    task, number = TaskContext.get().partitionId(), -1
    for whole in batches:
        for at in range(0, whole.num_rows, MOST_OWNERS):
            batch, number = whole.slice(at, MOST_OWNERS), number + 1
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
            owners = [np.zeros(0, np.int64)]
            for c in chunks(batch.column("text")):
                one, two = _hashed(c.hashes(), size, bits)
                for i, (lo, hi) in enumerate(zip(c.bounds[:-1], c.bounds[1:], strict=True)):
                    if hi - lo >= size:
                        found.append((one[lo : hi - size + 1], two[lo : hi - size + 1]))
                        owners.append(np.full(hi - lo - size + 1, c.first + i))
            h, c, d = (np.concatenate(x) for x in (*zip(*found, strict=True), owners))
            if not len(h):
                continue
            order, same = _sorted(h, c)
            h, c, d = h[order], c[order], d[order]
            own = np.append(True, ~same[1:] | (d[1:] != d[:-1]))  # a text's first of equal windows
            h, c, d, known, sent = h[own], c[own], d[own], (same | np.append(same[1:], False))[own], ~same[own]
            by = np.argsort(d, kind="stable")
            used, counts = np.unique(d, return_counts=True)
            keys = np.column_stack([np.asarray(batch.column(k)) for k in ("key", "tag")]).astype(np.int64)[used]
            batch_id = task << 32 | number
            rows = [(batch_id % ranges, batch_id, None, counts.astype(np.uint32).tobytes(), np.packbits(known[by]).tobytes(), np.packbits(sent[by]).tobytes(), keys.tobytes())]
            h, c, d = h[sent], c[sent], np.searchsorted(used, d[sent])
            cuts = np.searchsorted(((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[r], cuts[r + 1])
                by = np.argsort(d[part], kind="stable")
                used, counts = np.unique(d[part], return_counts=True)
                rows.append((r, batch_id, used.astype(np.uint16).tobytes(), counts.astype(np.uint32).tobytes(), h[part][by].tobytes(), _three(c[part][by]), None))
            yield _batch(rows, _SENT)


def _three(checks: np.ndarray) -> bytes:
    """The low 24 bits of each number."""
    return np.ascontiguousarray(checks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _four(packed: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(packed) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _again(rows: pa.Table) -> pa.Table:
    """Of one range, for each batch a bit for each window: whether another batch sent it too; rows with keys go on as they are."""
    passed = rows.filter(rows["keys"].is_valid())
    rows = rows.filter(rows["keys"].is_null())
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"]]
    ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
    h = np.concatenate([np.zeros(0, np.uint64), *parts])
    c = np.concatenate([np.zeros(0, np.uint32), *(_four(x.as_buffer()) for x in rows["checks"])])
    order, same = _sorted(h, c)
    hit = np.zeros(len(h), bool)
    hit[order] = same | np.append(same[1:], False)[: len(order)]
    ids = zip(*(rows[k].to_pylist() for k in ("range", "batch", "owners", "counts")), strict=True)
    out = [(r, b, o, n, np.packbits(hit[ends[i] : ends[i + 1]]).tobytes(), None, None) for i, (r, b, o, n) in enumerate(ids)]
    return pa.concat_tables([pa.Table.from_batches([_batch(out, _BACK)]), passed])


_FOUND = "key bigint, tag bigint, bits binary"


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _gather(rows: pa.Table) -> pa.Table:
    """For each text of a batch that has repeated windows, a bit for each of its distinct windows in order."""
    head = rows.filter(rows["keys"].is_valid()).to_pylist()[0]
    sizes, keys = np.frombuffer(head["counts"], np.uint32), np.frombuffer(head["keys"], np.int64).reshape(-1, 2)
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    again, sent = _bits(head["hashes"], ends[-1]), _bits(head["checks"], ends[-1])
    owners, hits = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for x in rows.filter(rows["keys"].is_null()).sort_by("range").to_pylist():
        counts = np.frombuffer(x["counts"], np.uint32)
        owners.append(np.repeat(np.frombuffer(x["owners"], np.uint16).astype(np.int64), counts))
        hits.append(_bits(x["hashes"], int(counts.sum())))
    again[sent] |= np.concatenate(hits)[np.argsort(np.concatenate(owners), kind="stable")]
    out = [(*keys[i].tolist(), np.packbits(again[a:b]).tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if again[a:b].any()]
    return pa.Table.from_batches([_batch(out, _FOUND)])


def _cut(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, out = batch.column("bits"), {k: [] for k in ("n_words", "n_removed", "kept_text")}
        for c in chunks(batch.column("text")):
            words = c.hashes() if found.slice(c.first, c.rows).null_count < c.rows else None
            for i in range(c.rows):
                lo, hi = c.bounds[i], c.bounds[i + 1]
                gone = np.zeros(hi - lo, bool)
                if found[c.first + i].is_valid:
                    order, same = _sorted(*_hashed(words[lo:hi], size, bits))
                    place = np.cumsum(~same) - 1
                    at = order[_bits(found[c.first + i].as_py(), int(place[-1]) + 1)[place]]
                    edge = np.zeros(hi - lo + 1, np.int32)
                    edge[at] += 1
                    edge[at + size] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                data, starts, ends = c.data, c.starts[lo:hi], c.ends[lo:hi]
                out["n_words"].append(int(hi - lo))
                out["n_removed"].append(int(gone.sum()))
                out["kept_text"].append(b" ".join([data[s:e].tobytes() for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]))
        new = {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept_text"], pa.binary()).cast(pa.string())}
        rest = batch.select([n for n in batch.schema.names if n not in ("text", "bits")])
        yield pa.RecordBatch.from_arrays([*rest.columns, *new.values()], names=[*rest.schema.names, *new])


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document, without its repeated passages.

    docs has doc_id (long) and text (string); other columns are ignored. A word goes if it is in
    a window of ``size`` words whose words also start anywhere else, in the same text or another.
    Null texts count as empty; a null doc_id keeps its row. Repeated rows are copies of each
    other and lose all windows. An empty table gives no rows. docs must give its rows in the same
    order when a task is run again, as tables read from files do. hash_bits: bits of the first hash.
    """
    bound_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("key"), F.xxhash64("text", doc_id.isNull()).alias("tag"), "text")
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, volume // WINDOW_BYTES // RANGE_WINDOWS)
    found = keyed.select("key", "tag", "text").mapInArrow(lambda it: _send(it, size, ranges, hash_bits), _SENT)
    found = found.repartitionById(ranges, F.col("range")).groupBy("range").applyInArrow(_again, _BACK)  # a range is a partition
    found = found.groupBy("batch").applyInArrow(_gather, _FOUND)
    found = found.groupBy("key", "tag").agg(F.first("bits").alias("bits"))  # equal rows have equal windows
    joined = keyed.join(found, ["key", "tag"], "left").select("doc_id", "text", "bits")
    return joined.mapInArrow(lambda it: _cut(it, size, hash_bits), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op6(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], size: int = WINDOW_WORDS) -> list[tuple[int, int, str]]:
    """The same by comparing windows as tuples of words, for tests."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
