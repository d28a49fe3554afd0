"""Exact top-k by inner product: the three-phase uniform threshold over lists split by dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from granary.sources.tables import materialise


def scaled(vectors: DataFrame, key: str, vector: str, factor: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component; vectors that are null or hold null or non-finite components are left out.

    Rows without a key are left out too; of several rows with one key the one with the greatest vector counts.
    """
    x = F.col(vector)
    good = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.where(good).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * factor)).alias("v"))
    return whole.groupBy("vec_id").agg(F.max("v").alias("v"))


def _part(v: Column, p: int, parts: int, width: int) -> Column:
    low, high = p * width // parts, (p + 1) * width // parts
    return F.slice(v, low + 1, high - low)


def _matrix(column: pa.ListScalar, width: int) -> np.ndarray:
    """Rows of a list of lists as int64, padded with zeros."""
    rows = column.values
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    at = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(at, sizes)] = flat
    return out


def _partials(parts: int, width: int, emit):
    """(query ids, cutoffs, query vectors, candidate ids, candidate vectors, part) blocks -> what `emit` takes of their partial scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                q, x = np.array(row["q_ids"].as_py()), np.array(row["x_ids"].as_py())
                scores = _matrix(row["q_v"], width) @ _matrix(row["x_v"], width).T
                at, which = emit(scores, q, x, row)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[at]), pa.array(np.full(len(at), row["part"].as_py(), np.int32)), pa.array(x[which]), pa.array(scores[at, which])],
                        ["query", "part", "candidate", "partial"])

    return run


# Stands for a query without a cutoff.
NO_CUT = -(1 << 62)
PARTIAL = "query long, part int, candidate long, partial long"


def _best(k: int):
    """The k greatest of each query; ties to the smaller id."""
    def emit(scores, q, x, row):
        k_here = min(k, scores.shape[1])
        by_id = np.argsort(x, kind="stable")
        top = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k_here]]
        return np.repeat(np.arange(len(q)), k_here), top.ravel()

    return emit


def _above(parts: int):
    """Entries of at least cutoff / parts; all of them where there is no cutoff."""
    def emit(scores, q, x, row):
        cut = row["q_cut"].values.to_numpy()
        return np.nonzero(parts * scores >= cut[:, None])

    return emit


# Pairs whose missing scores are computed at a time.
SLICE = 1 << 16
LOOKED_UP = "query long, candidate long, partial long, sum long, left int"


def _lookup(parts: int, width: int):
    """Blocks as in `_partials` with pairs of their ids -> the pairs' partial scores, but for those that cannot make up the query's cutoff.

    A pair has its sum over known parts and the number of parts left; what is left besides this part stays under cutoff / parts each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                q, x = (row[c].values.to_numpy() for c in ("q_ids", "x_ids"))
                cuts, q_v, x_v, by_id = row["q_cut"].values.to_numpy(), _matrix(row["q_v"], width), _matrix(row["x_v"], width), np.argsort(x)
                pairs = row["pairs"].values
                for at in range(0, len(pairs), SLICE):
                    query, candidate, known, left = (c.to_numpy() for c in pairs.slice(at, SLICE).flatten())
                    q_at, x_at = np.searchsorted(q, query), by_id[np.searchsorted(x, candidate, sorter=by_id)]
                    partial, cut = np.einsum("ij,ij->i", q_v[q_at], x_v[x_at]), cuts[q_at]
                    some = np.nonzero((cut == NO_CUT) | (known + partial - (left - 1) * (-cut // parts) >= cut))[0]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (query, candidate, partial, known, left)], ["query", "candidate", "partial", "sum", "left"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, parts: int = 2, query_block: int = 512, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` the k rows of `vectors` with the greatest inner product, without its own.

    Both have (vec_id, v) with integer components (`scaled`); ties go to the smaller vec_id. The lists of the method are the partial
    scores over each of `parts` runs of dimensions. Equal vectors form a class, of which only the k+1 smallest ids can ever be shown.
    1. Each part's k+1 best entries per query are gathered; the exact scores of these candidates give the (k+1)-th best as cutoff.
    2. The cutoff goes out with the query blocks. An entry can only reach it if one of its partial scores reaches cutoff / parts (also when scores are negative): each
       part returns all such entries.
    3. Entries whose known parts and the bound on the others fall short are dropped; missing parts are looked up, and the exact scores are ranked.
    Queries and candidates meet in blocks (query_block x block x part), joined by block number, in all three phases: pairs to look up travel as ids, vectors never
    once per pair. Stored vectors are many times the size of their files, by which Spark would broadcast them, so joins with them are hinted to be merged.
    Scores are 64-bit; vectors of different length are padded with zeros. Fewer than k other rows give as many ranks; empty inputs give no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors, "topk-rows")
    want = k + 1
    stats = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.array_size("v")), F.lit(1))).first()
    width = max(parts, stats[1])
    step = -(-width // parts)
    in_class = W.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= want)
    classes = materialise(kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.element_at("ids", 1)), "topk-classes")
    asked = materialise(queries.select(F.col("vec_id").alias("query_id"), "v").join(classes.select("v", "class").hint("merge"), "v"), "topk-asked")
    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v")
    counts = classes.count(), wanted.count()
    x_blocks, q_blocks = max(1, -(-counts[0] // block)), max(1, -(-counts[1] // query_block))
    x_block = lambda c: F.pmod(F.xxhash64(c), F.lit(x_blocks))
    q_block = lambda c: F.pmod(F.xxhash64(c), F.lit(q_blocks))

    def split(df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), _part(F.col("v"), p, parts, width).alias("s")) for p in range(parts)])))

    lists = split(classes.withColumn("b", x_block("class"))).select("class", "b", F.col("p.part").alias("part"), F.col("p.s").alias("s"))
    packed = materialise(lists.groupBy("b", "part").agg(F.collect_list("class").alias("x_ids"), F.collect_list("s").alias("x_v")), "topk-blocks").hint("merge")

    def blocks(asking: DataFrame) -> DataFrame:
        """Every query block, in order of ids, once for each candidate block of its part."""
        own = split(asking.withColumn("qb", q_block("class"))).select("class", "qb", "cut", F.col("p.part").alias("part"), F.col("p.s").alias("s"))
        one = own.groupBy("qb", "part").agg(F.sort_array(F.collect_list(F.struct("class", F.coalesce("cut", F.lit(NO_CUT)).alias("cut"), "s"))).alias("z"))
        return one.select("qb", "part", F.col("z.class").alias("q_ids"), F.col("z.cut").alias("q_cut"), F.col("z.s").alias("q_v"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(x_blocks - 1).cast("bigint"))).alias("b"))

    def meet(asking: DataFrame) -> DataFrame:
        """Every query block against every candidate block of its part, as rows of an equi-join."""
        return blocks(asking).join(packed, ["b", "part"]).select("q_ids", "q_cut", "q_v", "x_ids", "x_v", "part")

    def exact(asking: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query, candidate, score) of (query, candidate, part, sum, left) rows, one for each of the `left` missing parts, unless it stays below the cutoff."""
        pair = F.struct("query", "candidate", "sum", "left").alias("pair")
        told = pairs.select(x_block("candidate").alias("b"), "part", q_block("query").alias("qb"), pair)
        block_of = blocks(asking).select("b", "part", "qb", F.struct("q_ids", "q_cut", "q_v").alias("q"))
        # Dealt by the keys of the stored blocks, so that the blocks join where the pairs are gathered, and as many tasks as blocks share the pairs.
        dealt = block_of.unionByName(told, allowMissingColumns=True).repartition(x_blocks * parts, "b", "part").groupBy("b", "part", "qb")
        cells = dealt.agg(F.first("q", ignorenulls=True).alias("q"), F.collect_list("pair").alias("pairs")).where(F.size("pairs") > 0)
        found = cells.join(packed, ["b", "part"]).select("q.*", "x_ids", "x_v", "pairs").mapInArrow(_lookup(parts, step), LOOKED_UP)
        summed = found.groupBy("query", "candidate").agg((F.sum("partial") + F.max("sum")).alias("score"), (F.count(F.lit(1)) == F.max("left")).alias("whole"))
        return summed.where("whole").select("query", "candidate", "score")

    every = F.explode(F.array(*[F.lit(p) for p in range(parts)]))
    uncut = wanted.withColumn("cut", F.lit(None).cast("bigint"))
    near = meet(uncut).mapInArrow(_partials(parts, step, _best(want)), PARTIAL)
    near = near.withColumn("n", F.row_number().over(W.partitionBy("query", "part").orderBy(F.desc("partial"), "candidate"))).where(F.col("n") <= want)
    first = exact(uncut, near.select("query", "candidate").distinct().select("query", "candidate", every.alias("part"), F.lit(0).cast("bigint").alias("sum"), F.lit(parts).alias("left")))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "candidate")))
    cutoffs = materialise(ranked.where(F.col("n") == want).select(F.col("query").alias("class"), F.col("score").alias("cut")), "topk-cutoffs")

    cut = wanted.join(cutoffs, "class", "left")
    found = meet(cut).mapInArrow(_partials(parts, step, _above(parts)), PARTIAL)
    known = found.groupBy("query", "candidate").agg(F.sum("partial").alias("sum"), F.bit_or(F.expr("shiftleft(1, part)")).alias("have"), F.count(F.lit(1)).cast("int").alias("n"))
    known = materialise(known, "topk-known")
    open_ = known.where(F.col("n") < parts).select("query", "candidate", "sum", (F.lit(parts) - F.col("n")).alias("left"), "have", every.alias("part"))
    open_ = open_.where(F.col("have").bitwiseAND(F.expr("shiftleft(1, part)")) == 0)
    # Where every part reaches cutoff / parts, the sum reaches the cutoff.
    scored = known.where(F.col("n") == parts).select("query", "candidate", F.col("sum").alias("score")).unionByName(exact(cut, open_))
    shown = scored.join(classes.select(F.col("class").alias("candidate"), "ids").hint("merge"), "candidate").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = [F.desc("score"), F.col("vec_id")]
    shown = shown.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*by_score))).where(F.col("n") <= want)
    own = asked.select("query_id", F.col("class").alias("query")).join(shown, "query").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*by_score))
    return own.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
