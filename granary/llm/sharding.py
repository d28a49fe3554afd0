"""Sharding: the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import rank_in, replace
from granary.operators.ordered import global_prefix_sum
from granary.sources.tables import materialise


def _greedy(cells: Column, cap: Column) -> Column:
    """Fill shards in order up to `cap`: (shards used, fill of the last, first cell of each further shard)."""
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("fill"), F.array().cast("array<int>").alias("cuts"))

    def step(a, x):
        fits = a["fill"] + x["size"] <= cap
        stay = F.struct(a["n"].alias("n"), (a["fill"] + x["size"]).alias("fill"), a["cuts"].alias("cuts"))
        cut = F.struct((a["n"] + 1).alias("n"), x["size"].alias("fill"), F.concat(a["cuts"], F.array(x["cell"])).alias("cuts"))
        return F.when(fits, stay).otherwise(cut)

    return F.aggregate(cells, start, step)


def plan(sizes: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """(giant cells, cells that begin a shard, smallest feasible capacity) for `sizes` (cell int, size long).

    Cells above the mean that is left for the others get a shard of their own (again, until none is above); the rest is cut
    contiguously: the smallest capacity for which greedy filling needs no more than the shards left is found by
    binary search, and the cuts are made under it. All of it is SQL over one array; its length is bounded by the number of cells.
    """
    limit = None
    while True:
        small = F.lit(True) if limit is None else F.col("size") <= limit
        rest, giants, largest = sizes.agg(
            F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)), F.count_if(~small), F.coalesce(F.max(F.when(small, F.col("size"))), F.lit(0))).first()
        mean = rest / max(1, shards - giants)
        if largest <= mean or giants >= shards - 1:
            break
        limit = mean
    left = shards - giants
    small = F.lit(True) if limit is None else F.col("size") <= limit
    row = sizes.agg(F.sort_array(F.collect_list(F.when(small, F.struct("cell", "size")))).alias("cells"),
                    F.sort_array(F.collect_list(F.when(~small, F.col("cell")))).alias("giants"))
    low = max(-(-rest // left), largest)
    steps = max(2, int(largest + 1).bit_length() + 2)  # the mean and the largest cell together are always enough

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        ok = _greedy(F.col("cells"), mid)["n"] <= left
        moved = F.when(ok, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
        return F.when(s["lo"] >= s["hi"], s).otherwise(moved)

    span = F.struct(F.lit(low).cast("bigint").alias("lo"), F.lit(low + largest).cast("bigint").alias("hi"))
    found = row.select("*", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve)["hi"].alias("cap"))
    found = found.withColumn("ends", _greedy(F.reverse("cells"), F.col("cap"))["cuts"])
    cut = _level(F.col("cells"), F.col("cap"), F.col("ends"), left, rest)["cuts"]
    giants_at, cuts, cap = found.select("giants", cut.alias("cuts"), "cap").first()
    return giants_at, cuts, cap


def _level(cells: Column, cap: Column, ends: Column, shards: int, total: int) -> Column:
    """Cut under the capacity `cap` so that every shard comes near the mean of what is left.

    Greedy filling alone leaves all the room in the last shard. Here a shard also closes at the mean, provided that the cells after it fit
    the shards after it; filling from the end (`ends`: last cells of its further shards) tells how many they need.
    """
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("fill"), F.lit(0).cast("bigint").alias("done"), F.array().cast("array<int>").alias("cuts"))

    def step(a, x):
        mean = (F.lit(total) - a["done"]) / F.greatest(F.lit(1), F.lit(shards + 1) - a["n"])
        needed = F.array_size(F.filter(ends, lambda c: c >= x["cell"])) + 1
        full = a["fill"] + x["size"] > cap
        close = (a["fill"] > 0) & (full | ((a["fill"] + x["size"] / 2 > mean) & (needed <= shards - a["n"])))
        stay = F.struct(a["n"].alias("n"), (a["fill"] + x["size"]).alias("fill"), a["done"].alias("done"), a["cuts"].alias("cuts"))
        cut = F.struct((a["n"] + 1).alias("n"), x["size"].alias("fill"), (a["done"] + a["fill"]).alias("done"), F.concat(a["cuts"], F.array(x["cell"])).alias("cuts"))
        return F.when(close, cut).otherwise(stay)

    return F.aggregate(cells, start, step)


def shard(rows: DataFrame, size: str, group: Column, order: str, shards: int = 40, cell_bits: int = 16) -> DataFrame:
    """`rows` with `shard` (0 to shards-1) and `slot` (gapless from 0 in it), sizes per shard as near equal as whole groups allow.

    Rows with equal `group` are an atomic group. Groups are ordered by a 64-bit hash; its first `cell_bits` bits make
    2^cell_bits cells, each a run of neighbouring groups, whose sizes are summed on the map side. The minimax cut runs over
    cells: a shard's excess from that is at most one cell, about shards / 2^cell_bits of a shard. A group larger than a mean shard
    takes a shard alone. Slots order a shard by (hash, `order`); a shard may spread over many tasks.

    A null group is the group of nulls, a null size counts 0; repeated rows get slots of their own; columns called shard or slot are
    replaced; an empty table gives an empty result.
    """
    placed = rows.withColumns({"__hash": F.xxhash64(group.isNull(), group), "__bytes": F.coalesce(F.col(size), F.lit(0)).cast("bigint")})
    placed = placed.withColumn("__cell", F.shiftrightunsigned("__hash", 64 - cell_bits).cast("int"))
    sizes = materialise(placed.groupBy(F.col("__cell").alias("cell")).agg(F.sum("__bytes").alias("size")), "shard-cells")
    giants, cuts, _ = plan(sizes, shards)
    at = rank_in(F.array(*[F.lit(c) for c in cuts]).cast("array<int>"), F.col("__cell"), max(1, len(cuts).bit_length() + 1)) if cuts else F.lit(0)
    if giants:
        alone = F.array_position(F.array(*[F.lit(g) for g in giants]), F.col("__cell"))
        at = F.when(alone > 0, (alone + (shards - len(giants) - 1)).cast("int")).otherwise(at)
    placed = replace(placed, {"shard": at.cast("int")})
    slotted = global_prefix_sum(placed, [F.col("__hash"), F.col(order)], {"__slot": F.lit(1)}, key=["shard"])
    out = replace(slotted, {"slot": F.col("__slot").cast("bigint")})
    return out.select(*[f"`{c}`" for c in rows.columns if c.lower() not in {"shard", "slot"}], "shard", "slot")
