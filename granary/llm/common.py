"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank_in(bounds: Column, value: Column, steps: int) -> Column:
    """How many elements of the ascending array `bounds` are <= value, by binary search (2^steps > length)."""
    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(bounds, mid) <= value
        moved = F.when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        return F.when(s["lo"] >= s["hi"], s).otherwise(moved)

    start = F.struct(F.lit(0).alias("lo"), F.array_size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def replace(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; one of the same name (case ignored) that is there already makes way."""
    names = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in columns.items()])
