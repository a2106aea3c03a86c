"""Reading the driver's parquet tables by name, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_PLANS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (id(spark), sf_dir, name)
    if key not in _PLANS:
        _PLANS[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _PLANS[key]


def spark_names(sf_dir: str) -> dict:
    """Template names -> Spark's path-addressed parquet relations."""
    d = sf_dir.rstrip("/")
    return {t: f"parquet.`{d}/{t}.parquet`" for t in TABLES}


def oracle_names() -> dict:
    """Template names -> the views the oracle has registered."""
    return {t: t for t in TABLES}
