"""Ordered computations that survive a hot key.

A plain window sends all rows of a key to one task, and a window without a key sends
the whole table to one task. The helpers here sort all rows by (key, order) into range
partitions of equal size, so a key lies in as many neighbouring partitions as it has rows
for. A window runs inside each (partition, key); what crosses a partition edge is carried
by a summary with one row per partition. Null keys are keys like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.sources.tables import cut_lineage, materialise

_PART = "__part"
_SLOT = "__slot"


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], last: bool = True) -> DataFrame:
    """The last (or first) row of each key as one aggregate.

    Partial aggregation keeps one candidate per key and map task, so a key that holds
    most of the table costs no more than any other.
    """
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    choose = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def _ranged(df: DataFrame, keys: list[str], order: Sequence[Column], tag: str) -> DataFrame:
    """`df` in (key, order) as a stored table with each row's place (`__id`) and range partition.

    Rows that tie in key and order follow a hash of all their columns, so that even one
    value with most of the rows is cut. The table is stored because both the window and
    the summary must see the same ranges.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    full = [*[F.col(f"`{k}`") for k in keys], *order, tie]
    sorted_ = df.repartitionByRange(*full).sortWithinPartitions(*full)
    stored = materialise(sorted_.withColumn("__id", F.monotonically_increasing_id()), tag)
    # The built-in id is the partition number (upper bits) and the position in it.
    return stored.withColumn(_PART, F.shiftright("__id", 33))


def _key(keys: list[str]) -> Column:
    """The key as one value that is equal to itself also where it is null."""
    return F.struct(F.lit(0).alias("k"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])


def keyed_shift(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], values: dict[str, Column], back: bool = True) -> DataFrame:
    """Add, per key, the `values` of the previous (or next) row in `order`; null where there is none."""
    keys = _cols(key)
    staged = df.withColumn("__row", F.struct(*[v.alias(n) for n, v in values.items()]))
    placed = _ranged(staged, keys, order, "keyed-shift")
    step = F.lag if back else F.lead
    inner = W.partitionBy(_PART, *keys).orderBy("__id")
    # A partition's first row may continue the key of the partition before (its last row that of the one after).
    mine, theirs = (F.min_by, F.max_by) if back else (F.max_by, F.min_by)
    edge = F.struct(_key(keys).alias("key"), F.col("__row").alias("row"))
    edges = placed.groupBy(_PART).agg(mine(_key(keys), "__id").alias("__mine"), theirs(edge, "__id").alias("__edge"))
    near = step("__edge").over(W.orderBy(_PART))
    edges = edges.select(_PART, F.when(F.col("__mine").eqNullSafe(near["key"]), near).alias("__edge"))
    local = placed.withColumn("__near", step("__row").over(inner)).join(F.broadcast(edges), _PART)
    value = F.coalesce("__near", F.when(_key(keys).eqNullSafe(F.col("__edge")["key"]), F.col("__edge")["row"]))
    return local.select(*[F.col(f"`{c}`") for c in df.columns], *[value[n].alias(n) for n in values])


# How a value is gathered inside a partition, and how what came before it is added.
_OWN = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _both(kind: str, ahead: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(own.isNull(), ahead).when(ahead.isNull(), own).otherwise(own + ahead)
    if kind == "last":
        return F.coalesce(own, ahead)
    better = ahead < own if kind == "min" else ahead > own  # a plain comparison, as values may be structs
    return F.when(own.isNull() | better, ahead).otherwise(own)


def keyed_fold(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Add, per key, running values in `order`: name -> (kind, column), where kind is sum, min, max or last (the last one that is not null).

    The row itself is left out if `before`. Nulls are passed over, as in a window; a value is null as long as there were only nulls.
    """
    keys, names = _cols(key), list(values)
    staged = df
    for i, (_, c) in enumerate(values.values()):
        staged = staged.withColumn(f"__v{i}", c)
    kinds = [kind for kind, _ in values.values()]
    placed = _ranged(staged, keys, order, "keyed-fold")
    carried = _carried(placed, keys, kinds)
    inner = W.partitionBy(_PART, *keys).orderBy("__id").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    local = placed
    for i, kind in enumerate(kinds):
        local = local.withColumn(f"__r{i}", _OWN[kind](F.col(f"__v{i}")).over(inner))
    joined = local.join(F.broadcast(carried), _PART)
    mine = _key(keys).eqNullSafe(F.col("__first"))
    out = [_both(kind, F.when(mine, F.col(f"__b{i}")), F.col(f"__r{i}")).alias(n) for i, (n, kind) in enumerate(zip(names, kinds))]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *out)


def _carried(placed: DataFrame, keys: list[str], kinds: Sequence[str]) -> DataFrame:
    """(part, first key, that key's values over earlier partitions): one row per partition.

    Only a partition's first key can have begun before it. Its values come from the unbroken
    row of partitions up to here that end with it; all but the first of them hold nothing else.
    """
    ends = placed.groupBy(_PART).agg(F.min_by(_key(keys), "__id").alias("__first"), F.max_by(_key(keys), "__id").alias("__last"))
    tails = placed.join(F.broadcast(ends.select(_PART, "__last")), _PART).where(_key(keys).eqNullSafe(F.col("__last")))

    def gathered(i: int, kind: str) -> Column:
        value = F.col(f"__v{i}")
        return F.max_by(value, F.when(value.isNotNull(), F.col("__id"))) if kind == "last" else _OWN[kind](value)

    tails = tails.groupBy(_PART).agg(*[gathered(i, kind).alias(f"__t{i}") for i, kind in enumerate(kinds)])
    along = W.orderBy(_PART)  # one row per partition: the only single-task step
    rows = ends.join(F.broadcast(tails), _PART).withColumn("__linked", F.col("__first").eqNullSafe(F.lag("__last").over(along)))
    starts = ~(F.col("__linked") & F.col("__first").eqNullSafe(F.col("__last")))
    rows = rows.withColumn("__chain", F.sum(starts.cast("int")).over(along))
    chain = W.partitionBy("__chain").orderBy(_PART).rowsBetween(W.unboundedPreceding, 0)
    for i, kind in enumerate(kinds):
        rows = rows.withColumn(f"__c{i}", _OWN[kind](F.col(f"__t{i}")).over(chain))
    return rows.select(_PART, "__first", *[F.when(F.col("__linked"), F.lag(f"__c{i}").over(along)).alias(f"__b{i}") for i in range(len(kinds))])


def keyed_running(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, per key, running sums in `order`. `F.lit(1)` summed is the row number."""
    return keyed_fold(df, key, order, {n: ("sum", c) for n, c in sums.items()})


def keyed_row_number(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Row number per key; rows that tie in `order` are numbered by a hash of their columns."""
    out = keyed_running(df, key, order, {name: F.lit(1)})
    return out.withColumn(name, F.col(name).cast("int"))


def keyed_dense_rank(df: DataFrame, key: str | Sequence[str], value: str, name: str) -> DataFrame:
    """Dense rank of `value` per key: number the key's distinct values, join the number back."""
    keys = _cols(key)
    ranked = keyed_row_number(df.select(*keys, value).distinct(), keys, [F.col(value)], name)
    return _join_back(df, ranked, [*keys, value], name)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Numbers start+1.. over the whole table in `order`, without a one-task window.

    Rows are range-partitioned and sorted; each partition is numbered by position and
    shifted by the sizes of the partitions before it. The sorted rows are checkpointed
    once, so both passes see the same ranges even if a task is run again.
    """
    taken = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The built-in id is the partition number (upper bits) and the position in it.
    taken = cut_lineage(taken.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    slot = F.col("__id").bitwiseAND((1 << 33) - 1)
    taken = taken.withColumn(_PART, part).withColumn(_SLOT, slot)
    sizes = taken.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the only single-task step, bounded by the partition count.
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = taken.join(F.broadcast(offsets), _PART)
    position = F.col("__before") + F.col(_SLOT) + 1 + start
    return numbered.select(*df.columns, position.cast("bigint").alias(name))


def global_prefix_sum(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Add sums over all rows before the current one in `order` (exclusive).

    With `key`, sums restart per key; a key may still spread over many partitions.
    """
    out = keyed_fold(df, list(key), order, {n: ("sum", c) for n, c in sums.items()}, before=True)
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums})


def global_dense_rank(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Dense rank over the whole table: number the distinct keys, join the number back."""
    keys = list(order)
    ranked = global_row_number(df.select(*keys).distinct(), [F.col(k) for k in keys], name, start)
    return _join_back(df, ranked, keys, name)


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rank (1 + number of smaller rows): prefix sums of the counts of distinct keys."""
    keys = list(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = global_prefix_sum(counts, [F.col(k) for k in keys], {name: F.col("__n")}).drop("__n")
    ranked = ranked.withColumn(name, (F.col(name) + 1).cast("bigint"))
    return _join_back(df, ranked, keys, name)


def _join_back(df: DataFrame, ranked: DataFrame, keys: list[str], name: str) -> DataFrame:
    renamed = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], name)
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, test, "left").select(*df.columns, name)


def qualify(df: DataFrame, columns: dict[str, Column], test: Column | str) -> DataFrame:
    """Filter on window columns without keeping them."""
    keep = df.columns
    condition = F.expr(test) if isinstance(test, str) else test
    return df.withColumns(columns).where(condition).select(*keep)
