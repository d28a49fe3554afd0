"""Slowly changing dimensions, snapshots, late corrections, day-by-day backfill.

The history operators order a key's rows by time. They use the range-partitioned helpers
of `ordered`, so one visitor with a third of all visits is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import sha256_base64, surrogate_key
from granary.operators.joins import null_safe_join
from granary.operators.ordered import global_dense_rank, keyed_shift, latest_per_key
from granary.sources.sinks import upsert
from granary.sources.tables import cut_lineage, materialise

HIGH_TS = "9999-12-31 00:00:00"
HASH = "hash_value"


def high_ts() -> Column:
    return F.lit(HIGH_TS).cast("timestamp_ntz")


def versions(batch: DataFrame, key: str, attrs: Sequence[str], ts: str, current: DataFrame | None = None) -> DataFrame:
    """Rows at which a key's attributes changed: (key, attrs, hash_value, valid_from, is_old).

    Rows of one key at one time collapse to the smallest hash first. `current` holds the
    open versions; they take part in the comparison and stay in the result.
    """
    rows = batch.select(key, *attrs, F.col(ts).alias("valid_from")).withColumn(HASH, sha256_base64(*attrs))
    pick = F.min(F.struct(HASH, *attrs)).alias("r")
    fresh = rows.groupBy(key, "valid_from").agg(pick).select(
        key, *[F.col("r")[a].alias(a) for a in attrs], F.col("r")[HASH].alias(HASH), "valid_from", F.lit(False).alias("is_old")
    )
    if current is not None:
        old = current.select(key, *attrs, HASH, "valid_from", F.lit(True).alias("is_old"))
        fresh = old.unionByName(fresh)
    order = [F.col("valid_from"), (~F.col("is_old")).alias("o"), F.col(HASH)]
    shifted = keyed_shift(fresh, key, order, {"__before": F.col(HASH)})
    changed = F.col("__before").isNull() | (F.col("__before") != F.col(HASH)) | F.col("is_old")
    return shifted.where(changed).drop("__before")


def validity(rows: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """Add valid_to (one second before the next version) and is_current."""
    order = order or [F.col("valid_from"), F.col(HASH)]
    shifted = keyed_shift(rows, key, order, {"__next": F.col("valid_from")}, back=False)
    return shifted.withColumn("valid_to", F.coalesce(F.col("__next") - F.expr("interval 1 second"), high_ts())).withColumn(
        "is_current", F.col("__next").isNull()
    ).drop("__next")


def scd2(batch: DataFrame, key: str, attrs: Sequence[str], ts: str, state: DataFrame | None = None, sk: str = "md5",
         name: str = "user_sk") -> DataFrame:
    """History of attribute changes, from scratch or on top of a stored dimension.

    Returns the rows to merge by the surrogate key: all rows on a first run; on later
    runs the versions that were open plus the new ones. `sk` is "md5" (of key and
    valid_from) or "int" (dense rank over valid_from and key, continued from the state).
    A batch must not be older than the open versions of its keys; `scd2_recut` takes any.
    """
    current = None if state is None else state.where("is_current")
    rows = versions(batch, key, attrs, ts, current)
    if sk == "int":
        if state is None:
            rows = global_dense_rank(rows, ["valid_from", key], name)
        else:
            top = state.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()  # an empty state has no maximum
            new = global_dense_rank(rows.where(~F.col("is_old")), ["valid_from", key], name)
            new = new.withColumn(name, F.col(name) + top)
            kept = current.select(key, *attrs, HASH, "valid_from", F.lit(True).alias("is_old"), name)
            rows = kept.unionByName(new)
    out = validity(rows, key)
    if sk == "md5":
        out = out.withColumn(name, surrogate_key(out, [key, "valid_from"]))
    return out.select(name, key, *attrs, HASH, "valid_from", "valid_to", "is_current")


def scd2_merge(state: DataFrame | None, rows: DataFrame, name: str = "user_sk") -> DataFrame:
    """The stored dimension after merging the rows of `scd2` by surrogate key."""
    return rows if state is None else upsert(state, rows, name)


def scd2_recut(state: DataFrame | None, batch: DataFrame, key: str, attrs: Sequence[str], ts: str, source: DataFrame | None = None,
               sk: str = "md5", name: str = "user_sk") -> DataFrame:
    """The stored history after a batch whose rows may be older than versions already stored.

    Per key of the batch, the versions from its earliest new time on and the one before
    are taken out. The stretch from that time is built again from `source` (all rows
    loaded so far, the batch included), starting from the version before, so any order of
    batches gives the history of one load. Without `source` the stored versions stand for
    what was seen before: a late version then lasts up to the next stored change. Versions
    that come out again keep their surrogate key; new integer keys follow the largest one.
    """
    if state is None:
        return scd2(batch, key, attrs, ts, sk=sk, name=name)
    since = batch.groupBy(key).agg(F.min(ts).cast("timestamp_ntz").alias("__since"))
    touched = materialise(null_safe_join(state, since, [key]), "scd2-touched")
    later = touched.where(F.col("valid_from") >= F.col("__since"))
    before = latest_per_key(touched.where(F.col("valid_from") < F.col("__since")), key, [F.col("valid_from")])
    if source is None:
        seen = batch.select(key, *attrs, F.col(ts).alias("__at")).unionByName(later.select(key, *attrs, F.col("valid_from").alias("__at")))
    else:
        seen = null_safe_join(source.select(key, *attrs, F.col(ts).alias("__at")), since, [key]).where(F.col("__at") >= F.col("__since"))
    rows = materialise(versions(seen, key, attrs, "__at", before), "scd2-rows")
    if sk == "int":
        top = state.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()
        held = touched.select(key, "valid_from", name)
        known = null_safe_join(rows, held, [key, "valid_from"], "left")
        new = global_dense_rank(known.where(F.col(name).isNull()).drop(name), ["valid_from", key], name).withColumn(name, F.col(name) + top)
        rows = known.where(F.col(name).isNotNull()).unionByName(new)
    out = validity(rows, key)
    if sk == "md5":
        out = out.withColumn(name, surrogate_key(out, [key, "valid_from"]))
    gone = later.select(name).unionByName(before.select(name))
    return state.join(gone, name, "left_anti").unionByName(out.select(*state.columns))


def first_seen(batch: DataFrame, key: str, attrs: Sequence[str], ts: str) -> DataFrame:
    """Each attribute set of a key with the first time it was seen."""
    rows = batch.withColumn(HASH, sha256_base64(*attrs))
    out = rows.groupBy(key, *attrs, HASH).agg(F.min(ts).cast("timestamp_ntz").alias("valid_from"))
    return out.select(key, *attrs, HASH, "valid_from")


def scd2_first_seen(batch: DataFrame, key: str, attrs: Sequence[str], ts: str, state: DataFrame | None = None,
                    name: str = "customer_sk") -> DataFrame:
    """History by first-seen attribute sets; sets that are already current add nothing."""
    new = first_seen(batch, key, attrs, ts)
    if state is None:
        rows = global_dense_rank(new, ["valid_from", key, HASH], name)
    else:
        current = state.where("is_current")
        new = new.join(current.select(key, HASH), [key, HASH], "left_anti")
        top = state.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()  # an empty state has no maximum
        new = global_dense_rank(new, ["valid_from", key, HASH], name).withColumn(name, F.col(name) + top)
        rows = current.select(key, *attrs, HASH, "valid_from", name).unionByName(new)
    out = validity(rows, key)
    return out.select(name, key, *attrs, HASH, "valid_from", "valid_to", "is_current")


def scd2_correct(state: DataFrame, batch: DataFrame, key: str, attrs: Sequence[str], ts: str, since: str,
                 name: str = "customer_sk") -> DataFrame:
    """Replay a corrected or late source over the history from `since` on.

    Rows of the batch that share (key, valid_from) with a stored row but differ replace
    its attributes; rows at unknown times are inserted; the rest of the history stays.
    Returns the rows to merge: every version from `since` on with validity recomputed,
    and the last earlier version of a touched key, whose end may move.
    """
    new = first_seen(batch, key, attrs, ts)
    edge = F.lit(since).cast("timestamp_ntz")
    late = new.where(F.col("valid_from") >= edge)
    recent = state.where(F.col("valid_from") >= edge)
    # The version just before the edge: it may now end earlier.
    before = state.where((F.col("valid_from") < edge) & (F.col("valid_to") >= edge - F.expr("interval 1 second")))
    columns = [name, key, *attrs, HASH, "valid_from"]
    same_time = [key, "valid_from"]
    matched = recent.select(name, *same_time, F.col(HASH).alias("__old")).join(late, same_time)
    corrected = matched.where(F.col("__old") != F.col(HASH)).select(*columns)
    missing = late.join(recent.select(*same_time), same_time, "left_anti")
    top = state.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()  # an empty state has no maximum
    inserted = global_dense_rank(missing, ["valid_from", key, HASH], name).withColumn(name, F.col(name) + top).select(*columns)
    kept = recent.join(corrected.select(name), name, "left_anti").select(*columns)
    rows = kept.unionByName(corrected).unionByName(inserted).unionByName(before.select(*columns))
    return validity(rows, key).select(*columns, "valid_to", "is_current")


def snapshot(batch: DataFrame, key: str, cols: Sequence[str], now: str | Column, strategy: str = "check",
             updated_at: str | None = None, state: DataFrame | None = None) -> DataFrame:
    """Snapshot table after one run: rows with valid_from and valid_to (null = current).

    check: a key gets a new row when `cols` differ (null-safe) from its current row; the
    old row closes at the run time `now`. timestamp: when `updated_at` is later than the
    current row's start; rows start and close at `updated_at`. The batch has one row per key.
    """
    starts = F.col(updated_at) if strategy == "timestamp" else (F.lit(now) if isinstance(now, str) else now)
    fresh = batch.withColumn("valid_from", starts.cast("timestamp_ntz"))
    if state is None:
        return fresh.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    columns = state.columns
    current = state.where(F.col("valid_to").isNull())
    held = current.select(F.col(key).alias("__key"), F.col("valid_from").alias("__from"), *[F.col(c).alias(f"__{c}") for c in cols])
    joined = fresh.join(held, F.col(key) == F.col("__key"), "left")
    if strategy == "timestamp":
        differs = F.col("valid_from") > F.col("__from")
    else:
        differs = F.lit(False)
        for c in cols:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = joined.where(F.col("__key").isNull() | differs)
    added = changed.withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).select(*columns)
    closing = changed.where(F.col("__key").isNotNull()).select(F.col(key).alias("__ck"), F.col("valid_from").alias("__end"))
    closed = state.join(closing, (F.col(key) == F.col("__ck")) & F.col("valid_to").isNull(), "left").withColumn(
        "valid_to", F.coalesce("valid_to", "__end")
    )
    return closed.select(*columns).unionByName(added)


def backfill(step: Callable[[DataFrame | None, DataFrame], DataFrame], batches: Iterable[DataFrame],
             state: DataFrame | None = None) -> DataFrame | None:
    """Run a load once per batch in order, each on the state the one before left.

    The state is checkpointed after every batch, so a plan never spans two of them.
    """
    for batch in batches:
        state = cut_lineage(step(state, batch))
    return state
