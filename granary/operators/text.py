"""Line search and markdown log scans on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import latest_per_key


def lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line with its number from 1; a line end at the very end adds no line."""
    body = F.regexp_replace(F.col(text), r"\r?\n$", "")
    return df.select("*", F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def grep(df: DataFrame, text: str, needle: str, ignore_case: bool = False) -> DataFrame:
    """Lines that contain `needle`. Texts without it are dropped before they are split."""
    if ignore_case:
        hit = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    else:
        hit = lambda c: F.contains(c, F.lit(needle))
    return lines(df.where(hit(F.col(text))), text).where(hit(F.col("line")))


def sessions(files: DataFrame) -> DataFrame:
    """(file_path, title, date, content): first line without `# `, and what follows `: ` in it."""
    first = F.regexp_extract("content", r"^([^\r\n]*)", 1)
    title = F.when(F.length("content") == 0, "unknown").otherwise(F.regexp_replace(first, "^(# )+", ""))
    out = files.select("file_path", title.alias("title"), "content")
    date = F.coalesce(F.try_element_at(F.split("title", ": "), F.lit(2)), F.lit("unknown"))
    return out.select("file_path", "title", date.alias("date"), "content")


def topics(files: DataFrame) -> DataFrame:
    """(name, source_file, completed) of the checklist lines; a name's last line wins."""
    marked = lines(files, "content").where(F.col("line").rlike(r"^- \[[x ]\] "))
    rows = marked.select(
        F.col("line").substr(7, 1 << 30).alias("name"), F.col("file_path").alias("source_file"), F.col("line").startswith("- [x]").alias("completed"), "line_no")
    return latest_per_key(rows, "name", [F.col("source_file"), F.col("line_no")]).drop("line_no")


def summary(session_rows: DataFrame, topic_rows: DataFrame) -> DataFrame:
    """Totals of sessions, topics and completed topics."""
    counts = topic_rows.agg(F.count(F.lit(1)).alias("total_topics"), F.count_if("completed").alias("completed_topics"))
    total = session_rows.agg(F.count(F.lit(1))).scalar()
    return counts.select(total.alias("total_sessions"), "total_topics", "completed_topics")
