"""Text search and log scans over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import text as X
from granary.plans.registry import query
from granary.sources import sinks
from granary.sources.tables import new_path, read_seed, table

_LINES = "select doc_id, unnest(generate_series(1, len(l))) as line_no, unnest(l) as line from (select doc_id, string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') as l from documents) q"


def grep(spark: SparkSession, root: str, needle: str, ignore_case: bool) -> DataFrame:
    return X.grep(table(spark, root, "documents").select("doc_id", "text"), "text", needle, ignore_case).select("doc_id", "line_no", "line")


query("text_grep", f"select doc_id, cast(line_no as integer) as line_no, line from ({_LINES}) q where contains(line, 'The')")(lambda spark, root: grep(spark, root, "The", False))
query("text_grep_ignore_case", f"select doc_id, cast(line_no as integer) as line_no, line from ({_LINES}) q where contains(lower(line), 'license')")(
    lambda spark, root: grep(spark, root, "LICENSE", True))


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """Documents as markdown logs: a dated title, a checklist line per quarter of a topic, the text."""
    return table(spark, root, "documents").selectExpr(
        "concat('logs/', lpad(cast(doc_id as string), 12, '0'), '.md') as file_path",
        r"""concat('# ', lang, ' log: ', date_format(date_add(date'2026-01-01', cast(doc_id % 365 as int)), 'yyyy-MM-dd'), '\n',
             if(doc_id % 2 = 0, '- [x] ', '- [ ] '), 'topic ', doc_id div 4, '\n', text) as content""")


_LOGS = """logs as (select 'logs/'||lpad(cast(doc_id as varchar),12,'0')||'.md' as file_path, '# '||lang||' log: '||strftime(date '2026-01-01'+cast(doc_id%365 as integer),'%Y-%m-%d')||chr(10)
  ||(case when doc_id%2=0 then '- [x] ' else '- [ ] ' end)||'topic '||(doc_id//4)||chr(10)||text as content, doc_id, lang from documents)"""
_TOPICS = """tl as (select file_path, unnest(generate_series(1, len(l))) as line_no, unnest(l) as line from (
  select file_path, string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') as l from logs) q),
topics as (select name, source_file, completed from (select substr(line,7) as name, file_path as source_file, starts_with(line,'- [x]') as completed,
  row_number() over (partition by substr(line,7) order by file_path desc, line_no desc) as rn from tl where regexp_matches(line,'^- \\[[x ]\\] ')) q where rn=1)"""
_SESSIONS = """sessions as (select file_path, lang||' log: '||strftime(date '2026-01-01'+cast(doc_id%365 as integer),'%Y-%m-%d') as title,
  strftime(date '2026-01-01'+cast(doc_id%365 as integer),'%Y-%m-%d') as date, content from logs)"""
query("log_sessions_scan", f"with {_LOGS}, {_SESSIONS} select file_path, title, date, content from sessions")(lambda spark, root: X.sessions(log_files(spark, root)))
query("log_topics_scan", f"with {_LOGS}, {_TOPICS} select * from topics")(lambda spark, root: X.topics(log_files(spark, root)))


def rescan(spark: SparkSession, root: str) -> DataFrame:
    """Scanning the same files again leaves the topics as they were."""
    found = X.topics(log_files(spark, root))
    stored = sinks.write_table(found, new_path(spark, "topics"))
    return sinks.upsert(stored, found, "name")


query("log_upsert_idempotent", f"with {_LOGS}, {_TOPICS} select * from topics")(rescan)
query("log_summary", f"""with {_LOGS}, {_TOPICS} select (select count(*) from logs) as total_sessions, count(*) as total_topics, count(*) filter (where completed) as completed_topics from topics""")(
    lambda spark, root: X.summary(X.sessions(log_files(spark, root)), X.topics(log_files(spark, root))))


def upper_column(df: DataFrame, position: int) -> DataFrame:
    """Upper-case the column at a position (from 0)."""
    name = df.columns[position]
    return df.withColumn(name, F.upper(name))


def csv_upper(spark: SparkSession, root: str) -> DataFrame:
    path = sinks.write_csv(table(spark, root, "part").select("p_partkey", "p_name", "p_type"), new_path(spark, "parts"))
    ddl = "p_partkey bigint, p_name string, p_type string"
    out = sinks.write_csv(upper_column(read_seed(spark, path, ddl), 1), new_path(spark, "upper"))
    return read_seed(spark, out, ddl)


query("csv_upper_job", "select p_partkey, upper(p_name) as p_name, p_type from part")(csv_upper)
query("fn_upper_column", "select p_partkey, upper(p_name) as p_name, p_brand from part")(
    lambda spark, root: upper_column(table(spark, root, "part").select("p_partkey", "p_name", "p_brand"), 1))
