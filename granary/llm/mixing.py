"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums, word budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SPACE, replace, word_count
from granary.operators.ordered import global_prefix_sum, global_row_number
from granary.sources.tables import materialise


def exponential_key(quality: Column, *parts: Column, seed: str = "mix") -> Column:
    """-ln(u) / quality with u in (0, 1) drawn from a hash of `parts`: the smaller, the earlier it is taken."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    drawn = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 48))) / quality


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add `target` to one row per source (__src, __total): weights repeat in the order of __src.

    A target above `most` times its source is cut there and the excess is shared again by weight until none is above.
    The loop carries one number, the words per unit of weight; each round is one aggregate over the sources.
    """
    numbered = global_row_number(sizes, [F.col("__src")], "__no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__no") - 1) % len(weights) + 1).cast("int"))
    table = materialise(numbered.select("__src", "__total", weight.alias("__w"), (F.col("__total") * float(most)).alias("__cap")), "mix-sources")
    level, before = 0.0, -1
    while True:
        capped = F.col("__cap") < F.col("__w") * level
        row = table.agg(
            F.sum("__total"), F.coalesce(F.sum(F.when(capped, F.col("__cap"))), F.lit(0.0)),
            F.sum(F.when(~capped, F.col("__w"))), F.count_if(capped)).first()
        total, held, free, count = row
        if total is None or free is None or count == before:
            break
        level, before = (total * float(share) - held) / free, count
    share_of = F.col("__w") * level
    return table.withColumn("__target", F.when((F.col("__total") == 0) | (F.col("__cap") < share_of), F.col("__cap")).otherwise(share_of))


def mix(docs: DataFrame, size: Column, quality: Column, parts: Sequence[str] = ("doc_id",), source: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target` (its source's) and `taken`, the words the mix takes of it.

    A source gives complete epochs first (every row that many times); what its target still lacks is taken by
    Efraimidis-Spirakis sampling: rows in ascending -ln(u)/quality, prefix sums of sizes up to the budget. The row at the
    edge gives the words that are left, so a source's words are its target, rounded down. Hot sources are spread: the prefix sum is
    range-partitioned by (source, key), and only one row per source goes back to the rows.

    Sources weigh by the ascending code points of their names, null last. A null size counts 0, a null or non-positive
    quality 1. Rows that tie on the key (repeated rows) share what is left at the edge in proportion to their sizes. Columns
    of the four names are replaced. An empty table gives an empty result.
    """
    good = F.when(quality > 0, quality).otherwise(F.lit(1.0))
    rows = docs.withColumns({
        "__src": F.when(F.col(source).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source))),
        "__size": F.coalesce(size, F.lit(0)).cast("bigint"),
        "__key": exponential_key(good, *[F.col(p) for p in parts], seed=seed)})
    grouped = materialise(rows.groupBy("__src", "__key").agg(F.sum("__size").alias("__n")), "mix-keys")
    plan = targets(grouped.groupBy("__src").agg(F.sum("__n").alias("__total")), weights, share, most)
    plan = plan.withColumn("__epochs", F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0)))
    plan = plan.withColumn("__budget", F.floor(F.col("__target")) - F.col("__epochs") * F.col("__total"))
    running = global_prefix_sum(grouped.where("__n > 0"), [F.col("__key")], {"__before": F.col("__n")}, key=["__src"])
    edge = running.join(plan.select("__src", "__budget"), "__src").where("__before <= __budget and __budget < __before + __n")
    edge = edge.select("__src", F.col("__key").alias("__cut"), (F.col("__budget") - F.col("__before")).alias("__left"), F.col("__n").alias("__tied"))
    plan = materialise(plan.join(edge, "__src", "left"), "mix-plan")
    joined = rows.join(plan, "__src")
    part = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(
        F.col("__key") == F.col("__cut"), F.floor(F.col("__size") * F.col("__left") / F.col("__tied"))).otherwise(F.lit(0))
    out = replace(joined, {
        "size": F.col("__size"), "source_size": F.col("__total"), "target": F.col("__target"),
        "taken": (F.col("__epochs") * F.col("__size") + part).cast("bigint")})
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}], "size", "source_size", "target", "taken")


def draw(docs: DataFrame, quality: Column, text: str = "text", words: Column | None = None, **options) -> DataFrame:
    """The mix itself, in the columns of `docs`: a row for each time its document is taken.

    The document at a source's edge is cut to the words left, joined by single blanks (`n_chars`, if there, follows).
    Documents of no words are in no mix. `words` is their number where it is known already, so that the keys are made without the texts.
    """
    mixed = mix(docs.withColumn("__text_size", word_count(text) if words is None else words), F.col("__text_size"), quality, **options).where("taken > 0")
    count = F.ceil(F.col("taken") / F.col("size"))
    copies = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    rest = (F.col("taken") - (F.col("__copy") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.split(F.regexp_replace(F.col(text), "^" + SPACE, ""), SPACE), 1, F.greatest(rest, F.lit(1))), " ")
    partial = F.col("__copy") * F.col("size") > F.col("taken")
    copies = copies.withColumn(text, F.when(partial, cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(partial, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return copies.select(*[f"`{c}`" for c in docs.columns])
