"""Named source tables, seeds, shards, and where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SCHEMAS: dict[tuple[str, int], T.StructType] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan the parquet table `name` below `root`."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    path = f"{root}/{name}.parquet"
    # Reading a footer for the schema is a job of its own; do it once per table, not per scan, and again when the table was rewritten.
    files, there = _file_system(spark, path)
    known = path, files.getFileStatus(there).getModificationTime()
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def storage_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in `spark.checkpoint.dir`. Only a local session may go
    without: it gets a fresh temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own for one intermediate table; nothing is ever overwritten."""
    return f"{storage_root(spark)}/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage so that a lost executor costs one read."""
    storage_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write `df` once as parquet below the shared folder and read it back.

    Unlike a checkpoint the result keeps column statistics, so later filters and
    column choices are pushed into the scan.
    """
    path = new_path(df.sparkSession, tag)
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The file system of `path` and the path as it knows it, whatever store that is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _file_system(spark, path)
    return files.exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    files, there = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(there)) if files.exists(there) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of an intermediate table that nothing reads any more."""
    files, there = _file_system(spark, path)
    files.delete(there, True)


def read_seed(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header line and declared column types; a bad value fails the read."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def read_dirty_csv(spark: SparkSession, path: str, schema: str, stray: str = ";") -> DataFrame:
    """CSV whose lines carry a stray character: strip it outside quotes, then parse.

    The parse is an expression on a text scan, so there is one pass over the file. A line that does not fit the schema
    even without the stray character fails the read, as in `read_seed`.
    """
    lines = spark.read.text(path)
    # A character is outside quotes if an even number of quotes follows.
    clean = F.regexp_replace("value", f'[{stray}](?=(?:[^"]*"[^"]*")*[^"]*$)', "")
    row = F.from_csv(clean, F.lit(schema), {"mode": "FAILFAST"})
    header = T.StructType.fromDDL(schema).fieldNames()
    return (
        lines.where(~clean.startswith(",".join(header)))
        .select(row.alias("row"))
        .select("row.*")
    )


def read_text_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Whole text files whose names match `glob`, one row per file."""
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    )


def read_shards(spark: SparkSession, path: str, schema: T.StructType, shard: str = "dt",
                day: str | None = None, pattern: str | None = None) -> DataFrame:
    """Date-sharded table: `day` reads one shard, `pattern` those that match.

    Both are predicates on the partition column, so unmatched folders are never listed
    into the scan.
    """
    df = spark.read.schema(schema).parquet(path)
    if day is not None:
        df = df.where(F.col(shard) == day)
    if pattern is not None:
        df = df.where(F.col(shard).rlike(pattern))
    return df


def date_spine(spark: SparkSession, first, last, name: str = "date_value", inclusive: bool = True) -> DataFrame:
    """One row per day. `first` / `last` are dates or ISO strings."""
    stop = F.to_date(F.lit(str(last)))
    if not inclusive:
        stop = F.date_sub(stop, 1)
    days = F.sequence(F.to_date(F.lit(str(first))), stop, F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))


def date_spine_of(df: DataFrame, column: str, name: str = "date_value") -> DataFrame:
    """One row per day between the smallest and largest `column` of `df`."""
    span = df.agg(F.min(F.to_date(column)).alias("lo"), F.max(F.to_date(column)).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(name))


def number_spine(spark: SparkSession, first: int, last: int, name: str) -> DataFrame:
    """Integers first..last."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))
