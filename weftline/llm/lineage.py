"""Intermediate tables in the folder that all executors share, and joins with size-checked sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_folder

__all__ = ["Shelf", "shared_folder", "small_side"]

#: Rows up to which a narrow side (ids, hosts, verdicts) is broadcast after it was counted, and bytes of text in it.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


class Shelf:
    """Parquet tables in the shared folder that cut a plan's lineage; drop() and clear() delete those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
        self.count = 0
        self.stored: list[DataFrame] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        self.stored.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables; whatever still reads them must have been written before."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._weftline_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        gone = {t._weftline_path for t in tables}
        self.stored = [t for t in self.stored if t._weftline_path not in gone]

    def clear(self, *keep: DataFrame) -> None:
        """Deletes all tables but those; whatever reads the others must have been written before."""
        kept = {t._weftline_path for t in keep}
        self.drop(*[t for t in self.stored if t._weftline_path not in kept])


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The stored table df with a broadcast hint if it was counted to be small, in rows and in bytes of text; else as it is, for a
    shuffled join."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    counted = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if counted["n"] <= rows and counted["size"] <= size else df
