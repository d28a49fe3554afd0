"""Data Vault loads: stage, hub, link, satellites, point-in-time and bridge.

Every load takes the staged batch and, optionally, the stored table (`state`), and
returns the rows to append. All grouping is by aggregates that combine on the map side
(`min` / `max` of structs), so a key with very many source rows is no problem, and
Catalyst can drop left joins of the stage that a load does not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.hashing import hash_diff, hash_key
from granary.operators.ordered import latest_per_key
from granary.sources.adapters import HIGH_DATE

# Fixed values of the ghost record.
GHOST_PK = "0" * 32
GHOST_DATE = "1900-01-01"


@dataclass(frozen=True)
class HashDiff:
    """Marks a hashed column as the hash of describing columns."""

    columns: tuple[str, ...]


def stage(df: DataFrame, derived: dict[str, Column | str], hashed: dict[str, str | Sequence[str] | HashDiff],
          load_date: str | Column | None = None) -> DataFrame:
    """Source columns plus derived ones, hash keys, hash differences and the load date.

    A derived value is a Column, the name of a column, or `!text` for a constant. Hashed
    columns whose inputs the source does not have are computed from those it has.
    """
    def value_of(value: Column | str) -> Column:
        if isinstance(value, str):
            return F.lit(value[1:]) if value.startswith("!") else F.col(value)
        return value

    extra = {name: value_of(value) for name, value in derived.items()}
    if load_date is not None:
        extra["load_date"] = F.to_date(F.lit(load_date)) if isinstance(load_date, str) else load_date
    out = df.withColumns(extra)
    new: dict[str, Column] = {}
    for name, spec in hashed.items():
        if isinstance(spec, HashDiff):
            new[name] = hash_diff(out, [c for c in spec.columns if c in out.columns])
        else:
            new[name] = hash_key(out, spec)
    return out.withColumns(new)


def _union(sources: DataFrame | Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    frames = [sources] if isinstance(sources, DataFrame) else list(sources)
    out = frames[0].select(*columns)
    for other in frames[1:]:
        out = out.unionByName(other.select(*columns))
    return out


def _first_seen(df: DataFrame, pk: str, described: Sequence[str], ldts: str, source: str) -> DataFrame:
    row = F.min(F.struct(ldts, source, *described)).alias("row")
    return df.groupBy(pk).agg(row).select(pk, *[F.col("row")[c].alias(c) for c in (*described, ldts, source)])


def _only_new(rows: DataFrame, state: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return rows if state is None else rows.join(state.select(*keys), list(keys), "left_anti")


def hub(sources: DataFrame | Sequence[DataFrame], pk: str, nk: str | Sequence[str], ldts: str = "load_date",
        source: str = "record_source", state: DataFrame | None = None) -> DataFrame:
    """One row per business key; the earliest load wins; null keys are skipped."""
    names = [nk] if isinstance(nk, str) else list(nk)
    rows = _union(sources, [pk, *names, ldts, source]).where(F.col(pk).isNotNull())
    return _only_new(_first_seen(rows, pk, names, ldts, source), state, [pk])


def link(sources: DataFrame | Sequence[DataFrame], pk: str, fk: Sequence[str], ldts: str = "load_date",
         source: str = "record_source", state: DataFrame | None = None, hashed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """As a hub, over relationships; every foreign key must be present.

    `hashed` names the columns that each key is the hash of. Where they are integers or dates,
    which have one text each, and the link's key covers them all, rows are put together by
    these columns, and only the link's key is hashed before the stored links are looked up.
    """
    frames = [sources] if isinstance(sources, DataFrame) else list(sources)
    parts = {c: list(hashed[c]) for c in (pk, *fk)} if hashed else {}
    natural = list(dict.fromkeys(c for names in parts.values() for c in names))
    if len(frames) == 1 and parts and set(natural) == set(parts[pk]) and all(
            isinstance(frames[0].schema[c].dataType, (T.IntegralType, T.DateType)) for c in natural):
        rows = frames[0].select(*natural, ldts, source)
        for names in parts.values():
            rows = rows.where(" or ".join(f"`{c}` is not null" for c in names))
        first = rows.groupBy(*natural).agg(F.min(F.struct(ldts, source)).alias("row")).select(*natural, F.col("row")[ldts].alias(ldts), F.col("row")[source].alias(source))
        fresh = _only_new(first.withColumn(pk, hash_key(first, parts[pk])), state, [pk])
        return fresh.select(pk, *[hash_key(first, parts[c]).alias(c) for c in fk], ldts, source)
    rows = _union(frames, [pk, *fk, ldts, source])
    for c in (pk, *fk):
        rows = rows.where(F.col(c).isNotNull())
    return _only_new(_first_seen(rows, pk, fk, ldts, source), state, [pk])


def t_link(batch: DataFrame, pk: str, fk: Sequence[str], payload: Sequence[str], eff: str = "effective_from",
           ldts: str = "load_date", source: str = "record_source", state: DataFrame | None = None) -> DataFrame:
    """Insert-only transactions: a key is stored once with its payload."""
    rows = batch.where(F.col(pk).isNotNull())
    for c in fk:
        rows = rows.where(F.col(c).isNotNull())
    return _only_new(_first_seen(rows, pk, [*fk, *payload, eff], ldts, source), state, [pk])


def sat(batch: DataFrame, pk: str, hashdiff: str, payload: Sequence[str], eff: str = "effective_from",
        ldts: str = "load_date", source: str = "record_source", state: DataFrame | None = None,
        digests: bool = False, one_date: bool = False) -> DataFrame:
    """Append a version when its hash differs from the version before it.

    One row per (key, load) first, so the comparison runs over loads, not over source rows. The
    latest stored version is joined in as (key, load, hash); hinted to be merged, as Spark takes
    stored hashes for far smaller than they are. `digests` says that key and hash are hex texts
    of md5, as `stage` makes them: these travel as 16 bytes, which sort alike. `one_date` says
    that all of the batch has the same load date: a key then has one row and needs no window.
    """
    names = [hashdiff, *payload, eff, ldts, source]
    packed = (lambda c: F.unhex(c).alias(c)) if digests else F.col
    rows = batch.where(F.col(pk).isNotNull()).select(packed(pk), packed(hashdiff), *payload, eff, ldts, source)
    # With one date the group is the key; the date then is the same in all its rows.
    keys, dates = ([pk], [ldts]) if one_date else ([pk, ldts], [])
    row = F.min(F.struct(hashdiff, eff, source, *payload, *dates)).alias("row")
    fresh = rows.groupBy(*keys).agg(row).select(pk, *[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in names])
    before = F.lit(None)
    if not one_date:
        # A key has one row per load date, so a window group is as long as the list of loads.
        along = W.partitionBy(pk).orderBy(ldts)
        fresh = fresh.withColumn("__prior", F.lag(F.struct(ldts, hashdiff)).over(along))
        before = F.col("__prior")[hashdiff]
    if state is not None:
        held = latest_per_key(state.select(packed(pk), packed(hashdiff), ldts), pk, [F.col(ldts), F.col(hashdiff)])
        held = held.select(F.col(pk).alias("__pk"), F.struct(ldts, hashdiff).alias("__held"))
        fresh = fresh.join(held.hint("merge"), F.col(pk) == F.col("__pk"), "left")
        # The stored version is the one before if it is no later than the row and later than any other row; null is the earliest date.
        since = F.col("__held")[ldts]
        applies = F.col("__held").isNotNull() & (since.isNull() | F.coalesce(since <= F.col(ldts), F.lit(False)))
        if not one_date:
            prior = F.col("__prior")[ldts]
            later = (prior.isNull() & since.isNotNull()) | F.coalesce(prior < since, F.lit(False))
            applies = applies & (F.col("__prior").isNull() | later)
        before = F.when(applies, F.col("__held")[hashdiff]).otherwise(before)
    changed = fresh.where(before.isNull() | (before != F.col(hashdiff)))
    wide = (lambda c: F.lower(F.hex(c)).alias(c) if c in (pk, hashdiff) else F.col(c)) if digests else F.col
    return changed.select(*[wide(c) for c in (pk, *names)])


def eff_sat(batch: DataFrame, pk: str, dfk: Sequence[str], sfk: str, start: str, end: str, eff: str = "effective_from",
            ldts: str = "load_date", source: str = "record_source", state: DataFrame | None = None) -> DataFrame:
    """Effectivity of a relationship: first seen, re-opened and closed records.

    With one left join to the latest stored record per key the three cases become one
    filter: no record yet; record closed and batch open; record open and batch closed.
    A closing row keeps the record source of the row it closes.
    """
    keys = [*dfk, sfk]
    names = [pk, *keys, start, end, eff, ldts, source]
    rows = batch.select(*names)
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    if state is None:
        return rows.distinct()
    high = F.to_date(F.lit(HIGH_DATE))
    order = [F.col(ldts), F.col(end), F.col(start), F.col(eff)]
    # Only what is read of the latest record travels, and rows are made distinct once, when those to keep are known.
    latest = latest_per_key(state.select(pk, start, end, eff, ldts, source), pk, order).select(
        F.col(pk).alias("__pk"), (F.to_date(end) == high).alias("__open"), F.col(source).alias("__source")
    )
    is_open = F.to_date(end) == high
    keep = F.col("__pk").isNull() | (~F.col("__open") & is_open) | (F.col("__open") & ~is_open)
    joined = rows.join(latest, F.col(pk) == F.col("__pk"), "left").where(keep)
    closing = F.col("__open") & ~is_open
    joined = joined.withColumn(source, F.when(closing, F.col("__source")).otherwise(F.col(source)))
    return joined.select(*names).distinct()


def ma_sat(batch: DataFrame, pk: str, cdk: Sequence[str], payload: Sequence[str], hashdiff: str, eff: str = "effective_from",
           ldts: str = "load_date", source: str = "record_source", state: DataFrame | None = None) -> DataFrame:
    """Multi-active satellite: a key's whole set is stored again when it changed.

    The sets are compared by counts: members of the batch, members of the latest stored
    set, and members in both (one equi-join). No set is ever gathered in one place.
    """
    names = [pk, *cdk, *payload, hashdiff, eff, ldts, source]
    rows = batch.select(*names).where(F.col(pk).isNotNull())
    for c in cdk:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.distinct()
    if state is None:
        return rows
    member = [pk, hashdiff, *cdk]
    last = state.groupBy(pk).agg(F.max(ldts).alias("__last"))
    stored = state.join(last, pk).where(F.col(ldts) == F.col("__last")).select(*member).distinct()
    # One row per member with a side mark; a member on both sides has marks 1 and 2.
    marks = rows.select(*member).distinct().withColumn("__side", F.lit(1)).unionByName(stored.withColumn("__side", F.lit(2)))
    sides = marks.groupBy(*member).agg(F.sum("__side").alias("__sides"))
    # A set is unchanged when every member is on both sides.
    verdict = sides.groupBy(pk).agg(F.max(F.col("__sides") != 3).alias("__changed")).where("__changed")
    return rows.join(verdict, pk, "left_semi").select(*names)


def xts(batch: DataFrame, pk: str, satellites: dict[str, str], ldts: str = "load_date", source: str = "record_source",
        state: DataFrame | None = None) -> DataFrame:
    """Log of which hash each satellite saw per load; `satellites` maps name -> hashdiff column.

    The satellites are unpivoted from one scan instead of one scan per satellite.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("satellite_name"), F.col(h).alias("hashdiff")) for n, h in satellites.items()])
    rows = (
        batch.where(F.col(pk).isNotNull())
        .select(pk, F.explode(entries).alias("e"), ldts, source)
        .select(pk, "e.satellite_name", "e.hashdiff", ldts, source)
        .distinct()
    )
    return _only_new(rows, state, [pk, "satellite_name", "hashdiff", ldts])


def append(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The stored table after a load."""
    return rows if state is None else state.unionByName(rows)


def current_sat(table: DataFrame, pk: str, hashdiff: str, ldts: str = "load_date") -> DataFrame:
    """Latest version of every key."""
    return latest_per_key(table, pk, [F.col(ldts), F.col(hashdiff)])


def latest_load(table: DataFrame, ldts: str = "load_date") -> DataFrame:
    """Rows of the latest load only; the date is a scalar subquery, not a join."""
    return table.where(F.col(ldts) == table.agg(F.max(ldts)).scalar())


def _as_of_array(as_of: DataFrame) -> Column:
    """The as-of dates as one array value. The spine has one row per day, never data rows."""
    return as_of.agg(F.sort_array(F.collect_list("as_of_date"))).scalar()


def _valid_dates(table: DataFrame, pk: str, ldts: str, as_of: DataFrame) -> DataFrame:
    """Each version once per as-of date at which it is the latest of its key."""
    # One row per key and load date: the window group is as long as the list of loads.
    versions = table.withColumn("__next", F.lead(ldts).over(W.partitionBy(pk).orderBy(ldts)))
    versions = versions.withColumn("__dates", _as_of_array(as_of))
    live = F.filter("__dates", lambda d: (d >= F.col(ldts)) & (F.col("__next").isNull() | (d < F.col("__next"))))
    return versions.withColumn("as_of_date", F.explode(live)).drop("__dates", "__next")


def _hub_dates(hub_table: DataFrame, pk: str, ldts: str, as_of: DataFrame) -> DataFrame:
    dated = hub_table.select(pk, ldts).withColumn("__dates", _as_of_array(as_of))
    return dated.select(pk, F.explode(F.filter("__dates", lambda d: d >= F.col(ldts))).alias("as_of_date"))


def pit(hub_table: DataFrame, pk: str, as_of: DataFrame, satellites: dict[str, DataFrame], ldts: str = "load_date") -> DataFrame:
    """Point-in-time table: per key and as-of date the latest version of each satellite.

    The joins meet one row per key, which holds the key's load dates of a satellite; the
    as-of dates come last, so no join ever multiplies versions with dates. Spark takes
    columns of stored hashes for far smaller than they are, so these joins are hinted to be
    merged: else a satellite would be gathered by the driver and broadcast.
    """
    out = hub_table.select(pk, ldts)
    for i, table in enumerate(satellites.values()):
        loads = table.groupBy(pk).agg(F.collect_set(ldts).alias(f"__loads{i}"))
        out = out.join(loads.hint("merge"), pk, "left")
    out = out.withColumn("__dates", _as_of_array(as_of))
    out = out.withColumn("as_of_date", F.explode(F.filter("__dates", lambda d: d >= F.col(ldts))))
    columns = [F.col(pk), F.col("as_of_date")]
    for i, name in enumerate(satellites):
        latest = F.array_max(F.filter(f"__loads{i}", lambda d: d <= F.col("as_of_date")))
        columns.append(F.coalesce(latest, F.to_date(F.lit(GHOST_DATE))).alias(f"{name}_ldts"))
        columns.append(F.when(latest.isNotNull(), F.col(pk)).otherwise(GHOST_PK).alias(f"{name}_pk"))
    return out.select(*columns)


@dataclass(frozen=True)
class Step:
    """One hop of a bridge: a link, its effectivity satellite, and the names to give."""

    link: DataFrame
    link_pk: str
    fk: str
    eff: DataFrame
    end: str
    name: str


def bridge(hub_table: DataFrame, pk: str, as_of: DataFrame, walk: Sequence[Step], ldts: str = "load_date") -> DataFrame:
    """Per key and as-of date the link rows whose latest effectivity is open."""
    out = _hub_dates(hub_table, pk, ldts, as_of)
    for step in walk:
        # One effectivity row per (link, load), then the dates at which it is the latest.
        eff = step.eff.groupBy(step.link_pk, ldts).agg(F.max(step.end).alias("__end"))
        live = _valid_dates(eff, step.link_pk, ldts, as_of).where(F.col("__end") > F.col("as_of_date"))
        live = live.select(
            F.col(step.link_pk).alias(f"{step.name}_pk"), "as_of_date",
            F.col("__end").alias(f"{step.name}_end_date"), F.col(ldts).alias(f"{step.name}_load_date"),
        )
        hop = step.link.select(F.col(step.link_pk).alias(f"{step.name}_pk"), step.fk)
        # Merged for the reason given in `pit`.
        hop = hop.join(live.hint("merge"), f"{step.name}_pk")
        hop = hop.withColumnRenamed(step.fk, pk) if step.fk != pk else hop
        out = out.join(hop.hint("merge"), [pk, "as_of_date"])
    return out
