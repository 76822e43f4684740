"""Tables and folders in the place that all executors share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: A key with more than one in HOT_PARTS of all rows (and HOT_LEAST rows) is hot
#: and dealt over SALTS tasks; so there are HOT_PARTS hot keys at most.
HOT_PARTS, HOT_LEAST, SALTS = 500, 256, 64


class Tables:
    """Written intermediate tables of one operator call.

    A written table cuts lineage and outlives lost executors.  ``drop`` removes
    one as soon as nothing lazy reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def hot_values(rows: DataFrame, key: str, weight: str | None = None) -> list[int]:
    """The hot keys of ``rows``, by number of rows or sum of ``weight``: HOT_PARTS at most."""
    counts = rows.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("rows_of_key"))
    total = rows.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0
    return [r[0] for r in counts.where(F.col("rows_of_key") > max(HOT_LEAST, total // HOT_PARTS)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], *by: str, how: str = "inner") -> DataFrame:
    """Joins on ``key``, with the rows of hot keys on the left dealt by ``by`` and
    copied on the right, where a key has one row."""
    if not hot:
        return left.join(right, key, how)

    def is_hot() -> Column:
        return F.coalesce(F.col(key).isin(hot), F.lit(False))

    left = left.withColumn("_salt", F.when(is_hot(), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    right = right.withColumn("_salt", F.explode(F.when(is_hot(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """The driver's rows.  From a list of tuples, Spark would start Python workers
    of another kind beside those of the tasks, and both kinds share the executor's memory."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: extra or clashing ones of the input play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])
