"""Embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, components.

Each table gives a vector as code the signs of its projections on some fixed random planes.

1. Equal vectors become one entity that counts for all of them.
2. Only codes and short sketches, 128 of the signs, are shuffled by table and code. A vector goes
   on in a table if the sketch of another one of its code there differs in so few bits as that of
   a linked pair does but once in some hundred million; most vectors go on in no table.
3. The vectors that go on are compared exactly, in double precision, once: in the first table
   where their codes agree. A group returns how many links each vector has and only as many links
   as connect the linked.

Codes with many vectors are cut into blocks and every pair of blocks is a group of its own, so no
group grows with the data. The number of planes and tables follows the number of vectors, so which
of the pairs near RECALL's edge are found may change as rows are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Written, bound_batches
from quillspark.llm.graph import components

COSINE = 0.95
#: Chance that a pair at the least cosine shares a code in some table; the number of tables follows.
RECALL = 0.995
#: Vectors of a code on average, from which the number of planes follows, between these bounds.
CODE_VECTORS = 256
PLANES = (8, 24)
#: Bits of a sketch, and by how many standard deviations a linked pair's may differ more than expected.
SKETCH_BITS = 128
DEVIATIONS = 6
#: Vectors of a block on average, and sketches that are compared with a block at once.
BLOCK = 1024
SKETCH_ROWS = 256
SEED = 17
#: Codes with more than one block that go to every task; beyond, they are joined.
LISTED_CODES = 50_000


def layout(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Tables, and planes in each, for n vectors. A plane parts a pair with probability angle / pi."""
    bits = min(PLANES[1], max(PLANES[0], math.ceil(math.log2(max(1, n / CODE_VECTORS)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log(1 - agree)), bits


def most_apart(cosine: float = COSINE) -> int:
    """In how many bits the sketches of linked vectors differ at most."""
    p = math.acos(cosine) / math.pi
    return math.floor(SKETCH_BITS * p + DEVIATIONS * math.sqrt(SKETCH_BITS * p * (1 - p)))


def planes(size: int, count: int) -> np.ndarray:
    """Normals of the planes for vectors of that size, the same in every task."""
    return np.random.default_rng([SEED, size]).standard_normal((size, count))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, in double precision, and which of them have a direction."""
    x = vectors.astype(np.float64)
    ok = np.isfinite(x).all(1)
    x = np.where(ok[:, None], x, 0)
    most = np.abs(x).max(1, initial=0)
    ok &= most > 0
    x = x / np.where(most > 0, most, 1)[:, None]
    return x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None], ok


def _raw(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The vectors that have a direction, as bytes."""
    for batch in batches:
        lists, ids = batch.column("embedding"), np.asarray(batch.column("vec_id"))
        sizes = np.diff(np.asarray(lists.offsets))
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        begins = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            raw = values[begins[at][:, None] + np.arange(size)]
            _, ok = unit(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[ok]]), pa.array(np.full(int(ok.sum()), size, np.int32)), pa.array([r.tobytes() for r in raw[ok]], pa.binary())], names=["vec_id", "size", "x"])


def _codes(batches: Iterator[pa.RecordBatch], tables: int, bits: int, kind: str) -> Iterator[pa.RecordBatch]:
    weights = 1 << np.arange(bits)
    for batch in batches:
        sizes, raw = np.asarray(batch.column("size")), batch.column("x").to_pylist()
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x, _ = unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), size))
            signs = x @ planes(size, max(tables * bits, SKETCH_BITS)) > 0
            code = (signs[:, : tables * bits].reshape(len(at), tables, bits) @ weights).astype(np.int32)
            sketch = np.packbits(signs[:, :SKETCH_BITS], axis=1).view(np.int64)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(code.ravel()))
            rest = batch.take(pa.array(at))
            new = [codes, pa.array([r.tobytes() for r in code], pa.binary()), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], names=[*rest.schema.names, "codes", "signs", "sketch0", "sketch1"])


_GROUP = ("size", "number", "code", "left", "right")


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """Gives work the rows of each group, which come one after the other and may end in a later batch."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.column_stack([np.asarray(held[k]) for k in _GROUP])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if len(cuts):
            yield from work(held.slice(0, cuts[-1]), keys[: cuts[-1]], np.append(0, cuts))
            held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield from work(held, np.column_stack([np.asarray(held[k]) for k in _GROUP]), np.array([0, len(held)]))


def _sides(block: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == left), np.flatnonzero(block == right)


def _sketched(rows: pa.Table, keys: np.ndarray, cuts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The rows whose sketch is near another one's of their group."""
    block, near = np.asarray(rows["block"]), np.zeros(len(rows), bool)
    sketch = np.column_stack([np.asarray(rows[f"sketch{i}"]).view(np.uint64) for i in (0, 1)])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first, second = _sides(block[lo:hi], *keys[lo, [3, 4]].tolist())
        first, second = first + lo, second + lo
        for k in range(0, len(first), SKETCH_ROWS):
            some = first[k : k + SKETCH_ROWS]
            close = sum(np.bitwise_count(sketch[some, i][:, None] ^ sketch[second, i]).astype(np.int16) for i in (0, 1)) <= most
            close &= some[:, None] != second
            near[some] |= close.any(1)
            near[second] |= close.any(0)
    yield from rows.filter(pa.array(near)).select(["entity", "size", "number", "code"]).to_batches()


def _compare_all(rows: pa.Table, keys: np.ndarray, cuts: np.ndarray, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    ids, lead, copies, block = (np.asarray(rows[k]) for k in ("entity", "lead", "copies", "block"))
    raw, signs = rows["x"].to_pylist(), rows["signs"].to_pylist()
    out = {"entity": [], "n": [], "a": [], "b": []}
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo > 1:
            x, _ = unit(np.frombuffer(b"".join(raw[lo:hi]), kind).reshape(hi - lo, -1))
            codes = np.frombuffer(b"".join(signs[lo:hi]), np.int32).reshape(hi - lo, -1)
            links, root = _compare(x, codes, copies[lo:hi], block[lo:hi], *keys[lo, [1, 3, 4]].tolist(), cosine)
            linked = np.flatnonzero(links)
            if len(linked):
                for k, v in (("entity", ids[lo:hi][linked]), ("n", links[linked]), ("a", lead[lo:hi][linked]), ("b", lead[lo:hi][root[linked]])):
                    out[k].append(v)
    if out["n"]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in out.values()], names=list(out))


def _compare(x: np.ndarray, codes: np.ndarray, copies: np.ndarray, block: np.ndarray, table: int, left: int, right: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """How many links each vector of a group has, between its two blocks or within its one, and the first of those it is linked with."""
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    first, second = _sides(block, left, right)
    pairs = []
    for lo in range(0, len(first), BLOCK):
        rows = first[lo : lo + BLOCK]
        i, j = np.nonzero(x[rows] @ x[second].T >= cosine - 1e-9)
        i, j = rows[i], second[j]
        if left == right:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            good &= ~(codes[a, :table] == codes[b, :table]).any(1)  # such a pair is an earlier table's
            pairs.append((a[good], b[good]))
    for a, b in pairs:
        links += sum(np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64) for i, j in ((a, b), (b, a)))
    while pairs:  # labels fall to the least of those linked
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    return links, root


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    vectors has vec_id (long) and embedding (array of floats or doubles); other columns are
    ignored. n_links: other vectors found with at least that cosine; component_id: the smallest
    vec_id that links reach; kept: whether it is the vector's own. A vector that is null, zero or
    holds a null or non-finite component links with nothing, as do vectors of different sizes. A
    null vec_id links with nothing and has null component_id and kept; rows that share a vec_id
    are vectors of their own whose links add up. An empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    kind = {"float": "f4", "double": "f8"}[kind]
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL)")
    raw = whole.mapInArrow(lambda it: _raw(it, kind), "vec_id bigint, size int, x binary")
    distinct = raw.groupBy("size", "x").agg(F.min("vec_id").alias("lead"), F.count("*").alias("copies"))
    distinct = Written(distinct.withColumn("entity", F.monotonically_increasing_id()), "distinct")
    tables, bits = layout(distinct.df.count(), cosine)
    schema = "size int, x binary, lead bigint, copies bigint, entity bigint, codes array<int>, signs binary, sketch0 bigint, sketch1 bigint"
    coded = Written(distinct.df.mapInArrow(lambda it: _codes(it, tables, bits, kind), schema), "codes")
    distinct.drop()

    slim = coded.df.select("entity", "size", "sketch0", "sketch1", F.posexplode("codes").alias("number", "code"))
    slim, counts = _in_blocks(slim)
    most = most_apart(cosine)
    near = slim.mapInArrow(lambda it: _by_group(it, lambda r, k, c: _sketched(r, k, c, most)), "entity bigint, size int, number int, code int")
    near = Written(near.distinct(), "near")
    rows, more = _in_blocks(near.df.join(coded.df.select("entity", "lead", "copies", "x", "signs"), "entity"))
    found = rows.mapInArrow(lambda it: _by_group(it, lambda r, k, c: _compare_all(r, k, c, cosine, kind)), "entity bigint, n bigint, a bigint, b bigint")
    found = Written(found, "links")
    for x in (counts, more, near):
        x.drop()

    digest = lambda: (F.xxhash64("size", "x").alias("one"), F.xxhash64("x", F.lit(SEED)).alias("two"))
    links = found.df.groupBy("entity").agg(F.sum("n").alias("n"))
    entities = coded.df.select("entity", "lead", "copies", *digest()).join(links, "entity", "left")
    members = raw.select("vec_id", *digest()).join(entities, ["one", "two"]).select("vec_id", "lead", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    members = Written(members, "members")
    groups = components(found.df.select("a", "b").unionByName(members.df.selectExpr("vec_id AS a", "lead AS b")))
    for x in (coded, found):
        x.drop()
    links = members.df.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = vectors.select("vec_id").join(links, "vec_id", "left").join(groups.df.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, Written]:
    """rows of entities by size, number and code, once for each pair of blocks that they take part in, and the table of big codes."""
    key = ["size", "number", "code"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).where(f"n > {2 * BLOCK}")
    many = Written(counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "counts")
    rows = rows.join(F.broadcast(many.df) if many.df.count() <= LISTED_CODES else many.df, key, "left")
    block: Column = F.coalesce(F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"), F.lit(0))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    rows = rows.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("blocks", "other")
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP), many


def op5(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


def brute_force(rows: list[tuple[int, list | None]], cosine: float = COSINE) -> dict[int, tuple[int, int, bool]]:
    """The same by all pairs, for tests."""
    root = {i: i for i, _ in rows}
    links = dict.fromkeys(root, 0)

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v]
    good = [(i, v / np.sqrt(v @ v)) for i, v in good if np.isfinite(v).all() and v.any()]
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and v @ w >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], top(i), top(i) == i) for i in root}
