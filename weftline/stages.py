"""Tables that a job writes and reads again: they cut a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.session import shared_folder


def path_of(spark: SparkSession, uri: str):
    """(file system, path) of a folder in any store that Spark writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = path_of(spark, uri)
    return fs.exists(path)


def delete(spark: SparkSession, uri: str) -> None:
    fs, path = path_of(spark, uri)
    fs.delete(path, True)


class Stages:
    """Written tables of one job. Use as a context manager where nothing that is returned reads them; else they stay in the shared
    folder until it is cleared."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/weftline-stages-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Deletes the tables of these numbers, in the order that they were put."""
        for k in numbers:
            delete(self.spark, f"{self.root}/{k}")

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)
