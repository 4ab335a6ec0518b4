"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quillspark.operators.lexical import with_checkpoints


class Written:
    """A table in the session's checkpoint folder. Plans on it know its size from its files, whatever it was made from."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        with_checkpoints(self.spark)
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(conf).delete(target, True)
