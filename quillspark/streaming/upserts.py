"""A keyed table that a stream updates, each micro-batch once whatever crashes (K4, K5).

Rows are dealt to buckets by key. A micro-batch writes anew the buckets it touches, as a version
of its own number, and then one line to the ledger: the batch and its buckets. A version without
its line doesn't exist for readers; a batch that the ledger has isn't applied again; one that was
cut off before its line is written over. Readers take each bucket's last version in the ledger;
older versions stay until the folder's owner removes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class UpsertTable:
    """path: a folder that driver and executors share; key, order and fields: columns.

    Of a key each field has its last value that isn't null, by order; at one order the larger
    value. If keep_for is given, keys whose last order is more than that below the greatest order
    that the table has seen are forgotten when their bucket is next written, and never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64, keep_for: int | None = None):
        self.spark, self.path, self.key, self.order, self.buckets, self.keep_for = spark, path.rstrip("/"), key, order, buckets, keep_for
        self.empty = spark.createDataFrame([], schema)
        self.fields = [c for c in self.empty.columns if c not in (key, order)]

    def _fs(self, name: str) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        fs, at = self._fs(name)
        return fs.exists(at)

    def ledger(self) -> list[dict[str, Any]]:
        """The batches applied so far in order, each with its buckets and the greatest order seen."""
        fs, folder = self._fs("ledger")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        paths = [f"{self.path}/ledger/{n}" for n in names if n.endswith(".json")]
        lines = self.spark.read.text(paths).collect() if paths else []
        return sorted((json.loads(r.value) for r in lines), key=lambda x: x["batch"])

    def _commit(self, line: dict[str, Any]) -> None:
        fs, begun = self._fs(f"ledger/{line['batch']}.begun")
        _, done = self._fs(f"ledger/{line['batch']}.json")
        out = fs.create(begun, True)
        out.write(bytearray(json.dumps(line).encode()))
        out.close()
        fs.rename(begun, done)

    def _versions(self, ledger: list[dict[str, Any]]) -> dict[int, int]:
        last = {b: (line["batch"], b in line["buckets"]) for line in ledger for b in (*line["buckets"], *line["emptied"])}
        return {b: v for b, (v, full) in last.items() if full}

    def _stored(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def _fresh(self, rows: DataFrame, seen: int | None) -> DataFrame:
        return rows if self.keep_for is None or seen is None else rows.where(F.col(self.order) >= seen - self.keep_for)

    def _merged(self, rows: DataFrame) -> DataFrame:
        last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(self.order, c)))[c].alias(c)
        return rows.groupBy(self.key).agg(F.max(self.order).alias(self.order), *map(last, self.fields)).select(*self.empty.columns)

    def read(self) -> DataFrame:
        """The table as of now."""
        ledger = self.ledger()
        return self._fresh(self._stored(self._versions(ledger)), ledger[-1]["seen"] if ledger else None)

    def apply(self, batch: DataFrame, number: int, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Upserts a micro-batch; whether it was new. Rows without key or order don't count."""
        ledger = self.ledger()
        if any(line["batch"] == number for line in ledger):
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = self._merged(batch.where(F.col(self.key).isNotNull() & F.col(self.order).isNotNull()).select(*self.empty.columns))
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/incoming/{number}")
        new = self.spark.read.schema(StructType([*self.empty.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/incoming/{number}")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # no more than there are buckets
        seen = max((x for x in (new.agg(F.max(self.order)).first()[0], ledger[-1]["seen"] if ledger else None) if x is not None), default=None)
        old = self._stored({b: v for b, v in self._versions(ledger).items() if b in touched})
        both = self._fresh(self._merged(old.unionByName(new.drop("bucket"))), seen)
        both.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        before_commit()
        full = [b for b in touched if self._exists(f"data/{number}/bucket={b}")]
        self._commit({"batch": number, "buckets": full, "emptied": [b for b in touched if b not in full], "seen": seen})
        fs, incoming = self._fs(f"incoming/{number}")
        fs.delete(incoming, True)
        return True

    def sink(self, stream: DataFrame, checkpoint: str, before_commit: Callable[[], None] = lambda: None):
        """A writer of a stream into the table; start() it."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: (self.apply(df, number, before_commit), None)[1])
