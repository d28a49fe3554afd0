"""Stored tables with a register of loads.

A load of a table is written to a folder of its own and counts only once it is entered in
the register, so a load that broke off is invisible and is simply run again, and one that
is registered is never run twice. Loads read the stored table, not the plans that made it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import children, exists


class Ledger:
    """Tables below `path`: tables/<name>/load=<id>, and register/<name>/load=<id> with one row a load."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _data(self, name: str, load) -> str:
        return f"{self.path}/tables/{name}/load={load}"

    def loads(self, name: str) -> list[str]:
        """Ids of the registered loads of a table."""
        return [c.split("=", 1)[1] for c in children(self.spark, f"{self.path}/register/{name}")]

    def load(self, name: str, load, make: Callable[[DataFrame | None], DataFrame], source: str = "", mark: str | None = None) -> DataFrame:
        """Append what `make` gives for the stored table (None at first), unless this load is registered; the rows of the load.

        The register keeps the load's source, its number of rows, and its highest `mark` (a column that grows, such as a load date) as text.
        """
        if str(load) not in self.loads(name):
            rows = make(self.table(name))
            # Hashes as hex text take half the room with an entropy coder.
            rows.write.mode("overwrite").option("compression", "zstd").parquet(self._data(name, load))
            stored = self.spark.read.schema(rows.schema).parquet(self._data(name, load))
            high = F.max(mark).cast("string") if mark else F.lit(None).cast("string")
            entry = stored.agg(F.count(F.lit(1)).alias("rows"), high.alias("high_water")).withColumn("source", F.lit(source))
            entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/register/{name}/load={load}")
        return self.spark.read.parquet(self._data(name, load))

    def table(self, name: str) -> DataFrame | None:
        """All registered rows of a table, None before its first load."""
        loads = self.loads(name)
        return self.spark.read.parquet(*[self._data(name, i) for i in loads]) if loads else None

    def register(self) -> DataFrame:
        """(table, load, source, high_water, rows): one row per registered load."""
        entries = None
        for name in children(self.spark, f"{self.path}/register") if exists(self.spark, f"{self.path}/register") else []:
            rows = self.spark.read.option("basePath", f"{self.path}/register/{name}").parquet(f"{self.path}/register/{name}")
            rows = rows.select(F.lit(name).alias("table"), F.col("load").cast("string").alias("load"), "source", "high_water", "rows")
            entries = rows if entries is None else entries.unionByName(rows)
        return entries if entries is not None else self.spark.createDataFrame([], "table string, load string, source string, high_water string, rows long")
