"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

A document's set holds the hashes of its distinct shingles. Let x and y have n and m tokens and
a Jaccard similarity of at least t. Under every total order of tokens they share one of the first
``n - ceil(t * n) + 1`` tokens of x and of the first ``m - ceil(t * m) + 1`` of y, and as the rest
of the longer one can hold fewer than ``t * max(n, m)`` common tokens, those prefixes share at
least ``t / (1 + t) * (n + m) - ceil(t * max(n, m)) + 1``. A pair must pass under each order.

The first order puts rare tokens first and serves as index; the others are permutations.

1. Tokens that only one document has come first in the first order. A document whose prefix they
   fill has no partner, so the tokens are counted once for all documents: a batch sends its
   distinct ones, packed by ranges of the hash, and gets back how many of each document's tokens
   others hold. Of a prose corpus a tenth goes on.
2. Documents with equal sets become one entity. The sets of what is left are made from the texts
   again, and their tokens are counted in the same way, for the real order of rarity.
3. The smallest entity of an index token is its leader, and all entities of a leader's tokens are
   its group; two entities that share an index token are in one group.
4. Pairs of a group are tested where their sets lie: a pair that passes the filter of every other
   order is verified at once on whole sets. A block emits only links that join what its other
   links don't, never all pairs.
5. A group of many blocks is first reduced: a leader is compared with all other members, then a
   member of those that it left, until that links few more. Blocks of members in different
   components are then compared with each other.

Two documents are in one component exactly if links join them; links within a component that
others already connect need no test. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Written, bound_batches
from quillspark.llm.graph import components
from quillspark.llm.words import chunks, mix, row_hashes, windows

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= 75 * union.
SIMILARITY = (75, 100)
#: Seeds of the token orders: the index's, then the filters'.
ORDERS = (11, 12, 13)
#: Columns with the other orders' prefixes, each token as 16 bits.
FILTERS = tuple(f"filter{seed}" for seed in ORDERS[1:])
#: Entities and tokens of a block on average.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
#: Tokens of a range of the hash on average: what one task counts at a time.
RANGE_TOKENS = 1 << 21
#: Bytes of text for a token, to tell the number of ranges.
TOKEN_BYTES = 6
#: Blocks of a group up to which all pairs of its blocks are compared at once.
DIRECT_BLOCKS = 4
#: A bigger group is reduced further while a round links more than this part of its members outside the largest component.
WORTH = 1 / 8
MOST_ROUNDS = 30
#: Entities up to which their keys are broadcast to find their texts (48 bytes each); beyond, the texts are shuffled.
BROADCAST_ROWS = 200_000

_U = np.uint64


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for c in chunks(texts):
        h = c.hashes(lower=True)
        w = windows(h, size)
        for lo, hi in zip(c.bounds[:-1], c.bounds[1:], strict=True):
            yield np.unique(w[lo : hi - size + 1]) if hi - lo >= size else row_hashes(h[lo:hi], size)


def _digests(s: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and two sums that tell it from others."""
    return len(s), int(s.sum(dtype=_U).astype(np.int64)), int(mix(s + _U(7)).sum(dtype=_U).astype(np.int64))


# -- tokens that several documents have ---------------------------------------------------------


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the hash that a token is in; it grows with the token."""
    return ((tokens >> _U(32)) * _U(ranges)) >> _U(32)


def _cuts(keys: np.ndarray) -> np.ndarray:
    """The bounds of runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _runs(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each value, the sum of the weights of all that equal it."""
    order = np.argsort(values, kind="stable")
    cuts = _cuts(values[order])
    out = np.empty(len(values), np.int64)
    if len(values):
        out[order] = np.repeat(np.add.reduceat(weights[order], cuts[:-1]), np.diff(cuts))
    return out


#: Documents that are numbered together at most, whatever the batches hold; a number has 16 bits.
MOST_OWNERS = 1 << 15
_SENT = "range int, batch bigint, owners binary, counts binary, single binary, several binary, measures binary"


def _send(batches: Iterator[pa.RecordBatch], size: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Of each batch a row with its documents' measures, and a row for each range of the hash with its distinct tokens.

    Tokens of one document of the batch come as they are, document by document; of the others, which are shared anyway,
    only one each, so that a token of all documents is sent once for a batch.
    """
    names = [x.split(" ")[0] for x in _SENT.split(", ")]
    task = TaskContext.get().partitionId()
    pieces = (whole.slice(at, MOST_OWNERS) for whole in batches for at in range(0, whole.num_rows, MOST_OWNERS))
    for number, batch in enumerate(pieces):
        sets = list(_sets(batch.column("text"), size))
        digests = np.array([_digests(s) for s in sets], np.int64).reshape(-1, 3)
        _, first = np.unique(digests, axis=0, return_index=True)
        tokens = np.concatenate([np.zeros(0, _U), *(sets[i] for i in first)])
        owner = np.repeat(first, [len(sets[i]) for i in first])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        cuts = _cuts(tokens)
        times = np.repeat(np.diff(cuts), np.diff(cuts))
        shared = np.bincount(owner[times > 1], minlength=len(sets))
        ids = batch.column("doc_id")
        measures = np.column_stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.int64), digests, shared]).astype(np.int64)
        several = np.unique(tokens[times > 1])
        tokens, owner = tokens[times == 1], owner[times == 1]
        key = _range_of(tokens, ranges).astype(np.int64) * (len(sets) + 1) + owner
        order = np.argsort(key, kind="stable")
        key, tokens = key[order], tokens[order]
        runs = _cuts(key)
        heads = key[runs[:-1]]
        run_range, run_owner, run_size = heads // (len(sets) + 1), (heads % (len(sets) + 1)).astype(np.uint16), np.diff(runs).astype(np.uint32)
        low, low_several = tokens.astype(np.uint32), several.astype(np.uint32)
        at = np.arange(ranges + 1)
        run_at, several_at = np.searchsorted(run_range, at), np.searchsorted(_range_of(several, ranges), at.astype(_U))
        batch_id = task << 32 | number
        rows = [(batch_id % ranges, batch_id, None, None, None, None, measures.tobytes())]
        for r in range(ranges):
            lo, hi, u, v = run_at[r], run_at[r + 1], several_at[r], several_at[r + 1]
            if hi > lo or v > u:
                rows.append((r, batch_id, run_owner[lo:hi].tobytes(), run_size[lo:hi].tobytes(), low[runs[lo] : runs[hi]].tobytes(), low_several[u:v].tobytes(), None))
        columns = [list(c) for c in zip(*rows, strict=True)]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


_BACK = "batch bigint, owners binary, counts binary, measures binary"


def _find_shared(rows: pa.Table) -> pa.Table:
    """How many tokens of each document of a range of the hash occur elsewhere too."""
    single, several = _joined(rows["single"], np.uint32), _joined(rows["several"], np.uint32)
    values = np.concatenate([single, several])
    times = _runs(values, np.repeat([1, 2], [len(single), len(several)]))[: len(single)]
    found = np.append(0, np.cumsum(times > 1))
    at, out = 0, []
    for batch, owners, counts, measures in zip(*(rows[k].to_pylist() for k in ("batch", "owners", "counts", "measures")), strict=True):
        if measures is not None:
            out.append((batch, None, None, measures))
            continue
        owners, ends = np.frombuffer(owners, np.uint16), at + np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64)
        shared = found[ends] - found[np.append(at, ends[:-1])[: len(ends)]]
        at = int(ends[-1]) if len(ends) else at
        some = shared > 0
        if some.any():
            out.append((batch, owners[some].tobytes(), shared[some].astype(np.uint32).tobytes(), None))
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["batch", "owners", "counts", "measures"])


_MEASURES = "doc_id bigint, n bigint, one bigint, two bigint, shared bigint"


def _gather(rows: pa.Table) -> pa.Table:
    """The documents of a batch with their measures."""
    measures = _joined(rows["measures"], np.int64).reshape(-1, 6)
    shared = measures[:, 5].copy()
    np.add.at(shared, _joined(rows["owners"], np.uint16), _joined(rows["counts"], np.uint32))
    ids = pa.array(measures[:, 0], mask=measures[:, 1] > 0)
    return pa.table([ids, *(pa.array(measures[:, i]) for i in (2, 3, 4)), pa.array(shared)], names=[x.split(" ")[0] for x in _MEASURES.split(", ")])


def measure(docs: DataFrame, size: int) -> Written:
    """doc_id, n, one, two and shared of each document: its set's size and digests, and how many of its tokens others hold.

    shared is of one of the documents with equal sets at least, and may count a few tokens too many, as a range of the hash
    is counted by 32 bits of it.
    """
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, volume // TOKEN_BYTES // RANGE_TOKENS)
    sent = docs.mapInArrow(lambda it: _send(it, size, ranges), _SENT)
    back = sent.groupBy("range").applyInArrow(_find_shared, _BACK)
    return Written(back.groupBy("batch").applyInArrow(_gather, _MEASURES), "measured")


# -- prefixes -----------------------------------------------------------------------------------


def prefix_size(n, similarity: tuple[int, int] = SIMILARITY):
    t, u = similarity
    return n - -(-t * n // u) + 1


def prefix(tokens: np.ndarray, seed: int, similarity: tuple[int, int] = SIMILARITY, classes: np.ndarray | None = None) -> np.ndarray:
    """The places of a set's first tokens under the order of that seed, with classes rare ones first, so many that similar sets must share one."""
    k = prefix_size(len(tokens), similarity)
    if k >= len(tokens):
        return np.arange(len(tokens))
    rank = mix(tokens + _U(seed))
    if classes is not None:
        rank = (classes.astype(_U) << _U(56)) | (rank >> _U(8))
    return np.argpartition(rank, k - 1)[:k]


def filter_values(tokens: np.ndarray, seed: int, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    return np.sort((tokens[prefix(tokens, seed, similarity)] >> _U(48)).astype(np.uint16))


_PACKS = "entity array<bigint>, lead array<bigint>, n array<bigint>, data binary"


def _remake(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of entities, from texts of their leading documents; other texts of these are passed over."""
    for batch in batches:
        sets = list(_sets(batch.column("text"), size))
        same = [_digests(s) == want for s, want in zip(sets, zip(*(batch.column(k).to_pylist() for k in ("n", "one", "two")), strict=True), strict=True)]
        rows = batch.select(["entity", "lead", "n"]).filter(pa.array(same, pa.bool_()))
        data = pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns, data], names=["entity", "lead", "n", "data"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [pa.array([batch.column(k).to_pylist()], pa.list_(pa.int64())) for k in ("entity", "lead", "n")]
        data = pa.array([b"".join(batch.column("data").to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*lists, data], names=["entity", "lead", "n", "data"])


_COUNTED = "range int, pack bigint, tokens binary, counts binary"


def _send_pack(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each pack and how often it has them, by ranges of the hash."""
    for batch in batches:
        for pack, data in zip(batch.column("pack").to_pylist(), batch.column("data").to_pylist(), strict=True):
            tokens, counts = np.unique(np.frombuffer(data, _U), return_counts=True)
            cuts = np.searchsorted(_range_of(tokens, ranges), np.arange(ranges + 1, dtype=_U))
            low, counts = tokens.astype(np.uint32), counts.astype(np.uint32)
            some = np.flatnonzero(np.diff(cuts))
            pieces = [[x[cuts[r] : cuts[r + 1]].tobytes() for r in some] for x in (low, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in pieces)], names=["range", "pack", "tokens", "counts"])


def _classify(rows: pa.Table) -> pa.Table:
    """The class of each token: the bit length of its count, so 1 for a token of one entity alone."""
    tokens, counts = _joined(rows["tokens"], np.uint32), _joined(rows["counts"], np.uint32).astype(np.int64)
    classes = np.frexp(_runs(tokens, counts).astype(float))[1].astype(np.uint8)
    cuts = np.append(0, np.cumsum([len(x) // 4 for x in rows["tokens"].to_pylist()]))
    out = pa.array([classes[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table([rows["range"], rows["pack"], out], names=["range", "pack", "classes"])


_RECORDS = "entity bigint, lead bigint, n bigint, tokens array<bigint>, " + ", ".join(f"{k} binary" for k in FILTERS) + ", data binary"


def _records(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Each entity's record: its index tokens, the other orders' prefixes and the whole set."""
    for batch in batches:
        for entity, lead, n, data, pieces in zip(*(batch.column(k).to_pylist() for k in ("entity", "lead", "n", "data", "pieces")), strict=True):
            tokens = np.frombuffer(data, _U)
            _, place = np.unique(tokens, return_inverse=True)
            classes = np.frombuffer(b"".join(p["classes"] for p in pieces), np.uint8)[place]
            cuts = np.append(0, np.cumsum(n))
            heads, filters, sets = [], [[] for _ in FILTERS], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                s, c = tokens[lo:hi], classes[lo:hi]
                at = prefix(s, ORDERS[0], similarity, c)
                heads.append(s[at[c[at] > 1]].view(np.int64))
                for seed, column in zip(ORDERS[1:], filters, strict=True):
                    column.append(filter_values(s, seed, similarity).tobytes())
                sets.append(s.tobytes())
            ends = np.append(0, np.cumsum([len(x) for x in heads])).astype(np.int32)
            index = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *heads])))
            columns = [*(pa.array(x, pa.int64()) for x in (entity, lead, n)), index, *(pa.array(x, pa.binary()) for x in filters), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["entity", "lead", "n", "tokens", *FILTERS, "data"])


def _near(measured: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Entities, each with its smallest document, whose prefix in the first order holds a token that others have."""
    t, u = similarity
    found = measured.groupBy("n", "one", "two").agg(F.min("doc_id").alias("lead"), F.max("shared").alias("shared"))
    return found.where(f"{u} * shared >= {t} * n").withColumn("entity", F.monotonically_increasing_id()).drop("shared")


def records_of(docs: DataFrame, near: DataFrame, size: int, similarity: tuple[int, int]) -> Written:
    """The records of the entities in near, which is a written table."""
    found, volume = near.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = F.broadcast(near) if found <= BROADCAST_ROWS else near
    texts = docs.join(wanted, F.col("doc_id") == F.col("lead")).select("entity", "lead", "n", "one", "two", "text")
    sets = texts.mapInArrow(lambda it: _remake(it, size), "entity bigint, lead bigint, n bigint, data binary")
    sets = sets.groupBy("entity").agg(*(F.first(c).alias(c) for c in ("lead", "n", "data")))
    packs = Written(sets.mapInArrow(_pack, _PACKS).withColumn("pack", F.monotonically_increasing_id()), "packs")
    ranges = max(8, volume // RANGE_TOKENS)
    sent = packs.df.select("pack", "data").mapInArrow(lambda it: _send_pack(it, ranges), _COUNTED)
    classes = sent.groupBy("range").applyInArrow(_classify, "range int, pack bigint, classes binary")
    pieces = classes.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("range", "classes"))).alias("pieces"))
    out = Written(packs.df.join(pieces, "pack").drop("pack").mapInArrow(lambda it: _records(it, similarity), _RECORDS), "records")
    packs.drop()
    return out


# -- comparing ----------------------------------------------------------------------------------


def similar(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least that."""
    (t, u), small, large = similarity, min(len(x), len(y)), max(len(x), len(y))
    if not small or u * small < t * large:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return u * both >= t * (len(x) + len(y) - both)


def least_shared(n, m, similarity: tuple[int, int] = SIMILARITY):
    """How many tokens the prefixes of similar sets of n and m tokens share at least."""
    t, u = similarity
    return np.maximum(1, -(-t * (n + m) // (t + u)) - -(-t * np.maximum(n, m) // u) + 1)


class _Filter:
    """The prefixes of some sets under one order. Values are 16 bits of a token; equal ones within a prefix can't lose a pair."""

    def __init__(self, prefixes: list[bytes], second: np.ndarray):
        self.kept = [np.unique(np.frombuffer(x, np.uint16)) for x in prefixes]
        self.slack = np.array([len(x) // 2 - len(k) for x, k in zip(prefixes, self.kept, strict=True)])
        values = np.concatenate([self.kept[j] for j in second])
        owner = np.repeat(second, [len(self.kept[j]) for j in second])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def passing(self, i: int, some: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which of some pass with set i."""
        lo, hi = np.searchsorted(self.values, self.kept[i], "left"), np.searchsorted(self.values, self.kept[i], "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.kept))
        return both[some] + self.slack[i] + self.slack[some] >= need


_KEY = ("leader", "left", "right")


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """Gives work the rows of each group, which come one after the other and may end in a later batch."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        keys = np.column_stack([np.asarray(held[k]) for k in _KEY])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if len(cuts):
            yield from work(held.slice(0, cuts[-1]), np.append(0, cuts))
            held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield from work(held, np.array([0, len(held)]))


def _joining(rows: pa.Table, cuts: np.ndarray, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of each group that join what other links of it don't."""
    t, u = similarity
    leader, lead, label, block, left, right, n = (np.asarray(rows[k]) for k in ("leader", "lead", "label", "block", "left", "right", "n"))
    filters, data = [rows[k].to_pylist() for k in FILTERS], rows["data"].to_pylist()
    group, a, b = [], [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first, second = np.flatnonzero(block[lo:hi] == left[lo]), np.flatnonzero(block[lo:hi] == right[lo])
        own, m, c = lead[lo:hi], n[lo:hi], label[lo:hi].copy()  # c: components as links join them
        if not len(first) or not len(second) or (c == c[0]).all():
            continue
        orders = [_Filter(x[lo:hi], second) for x in filters]
        for i in first:
            some = second[(c[second] != c[i]) & (u * np.minimum(m[i], m[second]) >= t * np.maximum(m[i], m[second]))]
            if left[lo] == right[lo]:
                some = some[some > i]
            for order in orders:
                if len(some):
                    some = some[order.passing(i, some, least_shared(m[i], m[some], similarity))]
            for j in some:
                if c[j] != c[i] and similar(np.frombuffer(data[lo + i], _U), np.frombuffer(data[lo + j], _U), similarity):
                    group.append(leader[lo])
                    a.append(own[i])
                    b.append(own[j])
                    c[c == c[j]] = c[i]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (group, a, b)], names=["leader", "a", "b"])


def _compare(rows: DataFrame, records: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (leader, a, b) of leading documents. rows: entity and label, and the pair of blocks of a leader's group that it takes part in."""
    whole = rows.join(records.drop("tokens"), "entity").repartition(*_KEY).sortWithinPartitions(*_KEY)
    return whole.mapInArrow(lambda it: _by_group(it, lambda r, c: _joining(r, c, similarity)), "leader bigint, a bigint, b bigint")


def _blocks_of(count: str, tokens: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _place(blocks: str) -> Column:
    """The block of an entity among so many of its group."""
    return F.pmod(F.xxhash64("entity", F.lit(3)), F.col(blocks)).cast("int")


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows with block and other in place of other with left and right, the pair of blocks."""
    return rows.select("leader", "entity", "label", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))


def _apart(rows: DataFrame) -> DataFrame:
    """Rows (leader, entity, lead, n, label) of groups with several labels, and whether the label is the one that most of the group has."""
    sizes = rows.groupBy("leader", "label").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("leader").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("most"))
    return rows.join(sizes.where("labels > 1"), "leader").selectExpr("leader", "entity", "lead", "n", "label", "label = most AS main")


def _chosen(apart: DataFrame, turn: int) -> DataFrame:
    """Of each group a member outside its largest component, as one, and the blocks that the group has."""
    one = F.min_by(F.when(~F.col("main"), F.struct("entity", "label")), F.when(~F.col("main"), F.xxhash64("entity", F.lit(turn)))).alias("one")
    sizes = apart.groupBy("leader").agg(one, F.count("*").alias("k"), F.sum("n").alias("t"))
    return sizes.select("leader", "one", _blocks_of("k", "t").alias("blocks"))


def _from_leaders(apart: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each group's chosen member against all members with other labels, in blocks of these."""
    others = apart.join(chosen, "leader").where("label <> one.label").select("leader", "entity", "label", _place("blocks").alias("block"))
    others = others.withColumns({"left": F.lit(-1), "right": F.col("block")})
    ones = chosen.select("leader", "one.entity", "one.label", F.lit(-1).alias("block"), F.lit(-1).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"))
    return others.unionByName(ones)


def _merged(apart: DataFrame, chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with one label for all labels of a group that its chosen member's links join: the largest component's, if among them."""
    linked = apart.join(found.select("leader", F.col("b").alias("lead")).distinct(), ["leader", "lead"]).select("leader", "label", "main")
    own = chosen.join(found.select("leader").distinct(), "leader").select("leader", F.col("one.label").alias("label"), F.lit(False).alias("main"))
    joined = linked.unionByName(own).groupBy("leader", "label").agg(F.max("main").alias("main"))
    to = joined.groupBy("leader").agg(F.max_by("label", F.struct("main", "label")).alias("to"))
    rows = apart.join(joined.join(to, "leader").select("leader", "label", "to"), ["leader", "label"], "left")
    return rows.select("leader", "entity", "lead", "n", F.coalesce("to", "label").alias("label"))


def _in_blocks(apart: DataFrame) -> DataFrame:
    """Rows once for each pair of blocks that they take part in; blocks of a group's largest component don't meet each other."""
    main, rest = F.col("main"), ~F.col("main")
    sizes = apart.groupBy("leader").agg(F.count_if(rest).alias("k"), F.sum(F.when(rest, F.col("n"))).alias("kt"), F.count_if(main).alias("m"), F.sum(F.when(main, F.col("n"))).alias("mt"))
    rows = apart.join(sizes.select("leader", _blocks_of("k", "kt").alias("k"), _blocks_of("m", "mt").alias("m")), "leader")
    block = F.when(main, F.col("k") + _place("m")).otherwise(_place("k"))
    return _pairs_of_blocks(rows.select("*", block.alias("block"), F.explode(F.expr("sequence(0, CASE WHEN main THEN k ELSE k + m END - 1)")).alias("other")))


def _big_groups(rows: DataFrame, records: DataFrame, similarity: tuple[int, int]) -> list[Written]:
    """Links of groups of many blocks: leaders against all, while that links many, then blocks of what is still apart."""
    tables, labelled = [], None
    for turn in range(MOST_ROUNDS):
        apart = Written(_apart(rows), "apart")
        if labelled:
            labelled.drop()
        left = apart.df.where("NOT main").count()
        if not left:
            apart.drop()
            break
        chosen = _chosen(apart.df, turn)
        tables.append(Written(_compare(_from_leaders(apart.df, chosen), records, similarity), "links"))
        labelled = Written(_merged(apart.df, chosen, tables[-1].df), "labelled")
        apart.drop()
        few = tables[-1].df.count() <= WORTH * left
        if few or turn == MOST_ROUNDS - 1:
            tables.append(Written(_compare(_in_blocks(_apart(labelled.df)), records, similarity), "links"))
            labelled.drop()
            break
        rows = labelled.df
    return tables


def _links(records: DataFrame, similarity: tuple[int, int]) -> list[Written]:
    """Tables with links (a, b) of leading documents that join all similar entities."""
    index = records.select("entity", "lead", "n", F.explode("tokens").alias("token"))
    leaders = index.groupBy("token").agg(F.min("entity").alias("leader"), F.count("*").alias("k")).where("k > 1").drop("k")
    groups = Written(index.join(leaders, "token").select("leader", "entity", "lead", "n").distinct(), "groups")
    sizes = groups.df.groupBy("leader").agg(F.count("*").alias("k"), F.sum("n").alias("t")).select("leader", _blocks_of("k", "t").alias("blocks"))
    rows = Written(groups.df.withColumn("label", F.col("lead")).join(sizes, "leader"), "groups")
    groups.drop()
    small = rows.df.where(F.col("blocks") <= DIRECT_BLOCKS).withColumn("block", _place("blocks"))
    small = _pairs_of_blocks(small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tables = [Written(_compare(small, records, similarity), "links")]
    large = rows.df.where(F.col("blocks") > DIRECT_BLOCKS).drop("blocks")
    if not large.isEmpty():
        tables += _big_groups(large, records, similarity)
    rows.drop()
    return tables


def near_components(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    docs has doc_id (long) and text (string); other columns are ignored. It must give its rows in
    the same order when a task is run again, as tables read from files do. component_id is the
    smallest doc_id that links reach, the document's own at least. A null, empty or blank text
    has no shingles and links with nothing. A row with a null doc_id links with nothing and has
    a null component_id. Rows that share a doc_id are one document with several texts: what is
    similar to one of them is linked with it. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = measure(docs, size)
    full = measured.df.where("n > 0 AND doc_id IS NOT NULL")
    leads = full.groupBy("n", "one", "two").agg(F.min("doc_id").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k")
    copies = Written(full.join(leads, ["n", "one", "two"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "copies")
    near = Written(_near(full, similarity), "near")
    records = records_of(docs, near.df, size, similarity)
    tables = _links(records.df, similarity)
    links = copies.df
    for x in tables:
        links = links.unionByName(x.df.select("a", "b"))
    found = components(links)
    for x in (near, records, copies, *tables):
        x.drop()
    out = measured.df.select("doc_id", F.col("n").alias("n_shingles")).join(found.df.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one document of each group: the one whose doc_id names the component.

    Of its rows with equal texts one stays, the first by its other columns as JSON; rows that
    share its doc_id but not their text all stay, and so do all rows with a null doc_id.
    """
    copies = near_components(docs, size, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    if rest:
        kept = kept.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("rest")).select("doc_id", "text", *(F.col(f"rest.{c}") for c in rest))
    else:
        kept = kept.distinct()
    return kept.select(*(f"`{c}`" for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def op4(docs: DataFrame) -> DataFrame:
    """near_components with five words and a similarity of 0.75; see there for odd rows."""
    return near_components(docs)


def brute_force(rows: list[tuple[int, str | None]], size: int = SHINGLE_WORDS) -> dict[int, tuple[int, int]]:
    """doc_id to set size and component, by comparing all pairs of sets of word tuples, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def top(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                a, b = top(rows[i][0]), top(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for (d, _), s in zip(rows, sets, strict=True)}
