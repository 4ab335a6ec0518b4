"""Token counts: a separator scan of flat, unindexed token files.

A file is nothing but token ids, each of a fixed number of bytes, with an end-of-document id
after every document. Files are cut into blocks; each block is searched for the separator in one
vector comparison and summed up in a row: its tokens, its separators, the tokens after the
last, and the places of the separators. A prefix scan of
the sums, by file, gives each block the number of documents before it and the open tokens that
its first separator closes, so documents may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, new_path
from quillspark.llm.words import chunks

#: Tokens of a block.
BLOCK_TOKENS = 1 << 16
#: Bytes of text that go to one file on average, a third of that in ids; a task reads a file whole, so this bounds tasks.
SHARD_TEXT_BYTES = 32 << 20
LEAST_SHARDS = 4
#: Bytes of an id, and the id that ends a document.
WIDTH = 2
SEPARATOR_ID = 0


def _scan(batches: Iterator[pa.RecordBatch], width: int, separator: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in _BLOCK.names[2:]}
        for raw in batch.column("bytes"):
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}", len(raw.as_buffer()) // width)
            at = np.flatnonzero(ids == separator)
            out["n_tokens"].append(len(ids))
            out["n_ends"].append(len(at))
            out["tail"].append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            out["ends"].append(at)
        new = [pa.array(v, _BLOCK.field(k).type) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *new], schema=_BLOCK)


_BLOCK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("n_ends", pa.int64()), ("tail", pa.int64()), ("ends", pa.list_(pa.int64()))])


def count_tokens(files: DataFrame, width: int = WIDTH, separator: int = SEPARATOR_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, document, first_token and n_tokens of every document in flat token files.

    files is what spark.read.format("binaryFile") gives: path and content; other columns are
    ignored. document counts from 0 in a file; n_tokens leaves the separator out. Tokens after a
    file's last separator are one more document; an empty file has none. Bytes that don't fill a
    token at a file's end are ignored. Files are read whole, so they should be shards of a bounded
    size; only their blocks are searched at a time.
    """
    bound_batches(files.sparkSession)
    step = width * block_tokens
    blocks = files.select(F.col("path").alias("file"), "content").where(F.length("content") >= width)
    blocks = blocks.select("file", "content", F.explode(F.expr(f"sequence(0L, CAST((length(content) - 1) DIV {step} AS BIGINT))")).alias("block"))
    blocks = blocks.select("file", "block", F.expr(f"substring(content, CAST(block * {step} + 1 AS INT), {step})").alias("bytes"))
    sums = blocks.mapInArrow(lambda it: _scan(it, width, separator), "file string, block bigint, n_tokens bigint, n_ends bigint, tail bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.withColumn("documents", F.coalesce(F.sum("n_ends").over(before), zero)).withColumn("tokens", F.coalesce(F.sum("n_tokens").over(before), zero))
    # where the open document began: after the last separator of an earlier block, or at 0
    begun = F.when(F.col("n_ends") > 0, F.col("tokens") + F.col("n_tokens") - F.col("tail"))
    sums = sums.withColumn("begun", begun)
    sums = sums.withColumn("open", F.coalesce(F.max("begun").over(before), zero))
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    rest = F.col("tokens") + F.col("n_tokens") - F.greatest(F.coalesce("begun", zero), F.col("open"))
    ends = F.when(last & (rest > 0), F.array_append("ends", F.col("n_tokens"))).otherwise(F.col("ends"))
    sums = sums.select("file", "documents", "tokens", "open", ends.alias("ends")).where(F.size("ends") > 0)
    # each end with the one before it, -1 for the block's first
    paired = F.arrays_zip(F.concat(F.array(F.lit(-1).cast("long")), F.slice("ends", 1, F.size("ends") - 1)).alias("before"), F.col("ends").alias("end"))
    found = sums.select("file", "documents", "tokens", "open", F.posexplode(paired).alias("number", "pair"))
    start = F.when(F.col("number") == 0, F.col("open")).otherwise(F.col("tokens") + F.col("pair.before") + 1)
    return found.select("file", (F.col("documents") + F.col("number")).alias("document"), start.alias("first_token"), (F.col("tokens") + F.col("pair.end") - start).alias("n_tokens"))


# -- flat files of a table's texts ------------------------------------------------------------


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            ids = (c.hashes() % np.uint64(0xFFFF) + np.uint64(1)).astype("<u2").tobytes()
            cuts = (c.bounds * 2).tolist()
            rest = batch.slice(c.first, c.rows).drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=[*rest.schema.names, "ids"])


def _keyed(docs: DataFrame, shards: int) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    return slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(shards)).cast("int"))


def write_flat(docs: DataFrame, path: str, shards: int) -> None:
    """The texts as flat token files, a shard each, in order of doc_id within it; ids are hashes of words, 1 to 65535, and 0 ends a document.

    Spark's text writer makes the files: a record is a document's bytes as they are, and the
    separator between records is the id 0. So they can be written to any store.
    """
    bound_batches(docs.sparkSession)
    rows = _keyed(docs, shards).mapInArrow(_ids, "doc_id bigint, tag bigint, shard int, ids binary")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tag")
    rows.select("shard", F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0" * WIDTH).partitionBy("shard").text(path)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of each document: writes them as flat token files, counts in these, and names the documents by their order.

    A null or empty text has 0 tokens. Rows with a null doc_id and repeated rows each keep theirs; other columns are ignored.
    An empty table gives no rows. The number of files follows the volume of the texts.
    """
    spark = docs.sparkSession
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, volume // SHARD_TEXT_BYTES)
    path = new_path(spark, "tokens")
    write_flat(docs, path, shards)
    counts = count_tokens(read_flat(spark, path)).withColumn("shard", F.regexp_extract("file", r"shard=(\d+)", 1).cast("int"))
    order = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "tag")
    names = _keyed(docs, shards).select("shard", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("document"))
    return names.join(counts, ["shard", "document"]).select("doc_id", "n_tokens")


SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
"""


def brute_force(ids: list[int], separator: int = SEPARATOR_ID) -> list[tuple[int, int]]:
    """first_token and n_tokens of each document of a file, one token at a time, for tests."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((start, i - start))
            start = i + 1
    return out + ([(start, len(ids) - start)] if start < len(ids) else [])
