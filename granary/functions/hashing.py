"""Hash keys and hash differences as Column expressions.

Each hash is one SQL expression text: it parses once, whatever its number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash texts.
KEY_NULL = "^^"
KEY_JOIN = "||"
SURROGATE_NULL = "_null_"
SURROGATE_JOIN = "-"
# Texts of numbers and times have no blanks and no small letters: there is nothing to trim.
_PLAIN = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_text(df: DataFrame, name: str) -> str:
    """SQL for a column's text form that does not depend on the engine's number printing."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"cast(cast(`{name}` as decimal(18,2)) as string)"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format(`{name}`, 'yyyy-MM-dd HH:mm:ss')"
    return f"cast(`{name}` as string)"


def hash_key(df: DataFrame, names: str | Sequence[str]) -> Column:
    """Business-key hash; null when every part is null, so that loads skip the row."""
    names = [names] if isinstance(names, str) else list(names)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, (T.IntegralType, T.DateType)):
        # The same value; these texts are never empty.
        return F.expr(f"md5({as_text(df, names[0])})")
    some = " or ".join(f"`{n}` is not null" for n in names)
    return F.expr(f"case when {some} then {_digest(df, names)} end")


def hash_diff(df: DataFrame, names: Sequence[str]) -> Column:
    """Hash of the describing columns, in name order; never null."""
    return F.expr(_digest(df, sorted(names)))


def _digest(df: DataFrame, names: Sequence[str]) -> str:
    """SQL for the hash of trimmed upper-case texts, with a marker for null or empty ones."""
    texts = [as_text(df, n) for n in names]
    if all(isinstance(df.schema[n].dataType, _PLAIN) for n in names):
        return f"md5(concat_ws('{KEY_JOIN}', {', '.join(f"coalesce({t}, '{KEY_NULL}')" for t in texts)}))"
    # A plain CASE, not nullif(): nullif becomes a projection of its own, which keeps
    # Catalyst from removing the unused outer joins below the hash.
    # A function over an array is not fused with the joins below. A stage with many hashes is then compiled
    # in small methods; fused it is one of more than 8000 bytes, which the JVM only interprets.
    cleaned = f"transform(array({', '.join(texts)}), t -> case when trim(t) <> '' then upper(trim(t)) else '{KEY_NULL}' end)"
    return f"md5(concat_ws('{KEY_JOIN}', {cleaned}))"


def surrogate_key(df: DataFrame, names: Sequence[str]) -> Column:
    """md5 over the columns' texts, nulls replaced by a marker."""
    parts = ", ".join(f"coalesce({as_text(df, n)}, '{SURROGATE_NULL}')" for n in names)
    return F.expr(f"md5(concat_ws('{SURROGATE_JOIN}', {parts}))")


def sha256_base64(*columns: str) -> Column:
    """base64 of the sha-256 of the columns' texts joined by '-', null as empty."""
    parts = ", ".join(f"coalesce(cast({c} as string), '')" for c in columns)
    return F.expr(f"base64(unhex(sha2(concat_ws('-', {parts}), 256)))")
