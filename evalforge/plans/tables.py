"""Table access for the driver's parquet folder (one file per table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The epoch of a run log row: its day, counted from 1970-01-01, so that no two months share one.
EPOCH_DAY_SQL = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)"


def epoch_day(ts: str = "ts") -> Column:
    return F.unix_date(F.col(ts).cast("date"))
