"""Access to the input tables as lazily read DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# lineitem has no two-column key; these six columns identify a row.
LINEITEM_KEY = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
)


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def file(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.file(name))

    def sql(self, text: str) -> DataFrame:
        """Run SQL text over the tables it names."""
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in NAMES:
            if name in words:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    @property
    def events_ts(self) -> DataFrame:
        """Events with ``ts`` as an instant, as stream operators require."""
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))
