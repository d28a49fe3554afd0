"""Graph jobs on edge tables `src, dst[, weight]`.

Every job is a loop of joins and aggregates. A round's result is checkpointed on shared
storage, so plans stay short and a lost executor costs one read. A stored table keeps
the size Spark guessed for its plan, which can be far too low, so tables that grow with
the graph are hinted to be merged: else Spark would broadcast them round by round. A
frontier is counted, and broadcast only up to `SMALL` rows; then the edges stay where
they are. AQE splits a vertex with very many edges as a skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import global_row_number
from granary.sources.tables import cut_lineage, materialise, new_path, remove

# Unions of checkpointed rounds are flattened every so many rounds.
FLATTEN = 6
# A frontier of at most so many rows (some 1 MB) is sent to the edges; a larger one is shuffled with them.
SMALL = 50_000


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _ahead(frontier: DataFrame, rows: int, edges: DataFrame) -> DataFrame:
    """The edges that leave a stored frontier of so many rows, with its columns."""
    sides = (frontier.hint("broadcast"), edges) if rows <= SMALL else (frontier, edges.hint("merge"))
    return sides[0].join(sides[1], F.col("node") == F.col("src"))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of everything reachable from the nodes of `sources` along src -> dst."""
    return _bfs(cut_lineage(edges.select("src", "dst")), sources, max_depth)


def _bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """As `bfs`, on stored edges; an edge given twice is followed twice and found once."""
    seen = frontier = cut_lineage(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    depth, rows = 0, frontier.count()
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = _ahead(frontier, rows, edges).select(F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        rows = frontier.count()
        if not rows:
            break
        seen = seen.unionByName(frontier)
        if depth % FLATTEN == 0:
            seen = cut_lineage(seen)
    return seen


def _start(edges: DataFrame, root) -> DataFrame:
    """The node `root` as a table; empty if no edge has it."""
    ends = edges.where((F.col("src") == root) | (F.col("dst") == root))
    return vertices(ends).where(F.col("node") == root)


def lineage(edges: DataFrame, root, max_depth: int | None = None, upstream: bool = False) -> DataFrame:
    """Nodes below (or above) a node with their distance; empty for an unknown node."""
    edges = cut_lineage((reverse(edges) if upstream else edges).select("src", "dst"))
    return _bfs(edges, _start(edges, root), max_depth)


def distances(edges: DataFrame, root) -> DataFrame:
    """Hop distance of every vertex from `root`; -1 when it cannot be reached."""
    edges = cut_lineage(edges.select("src", "dst"))
    found = _bfs(edges, _start(edges, root))
    return vertices(edges).join(found.hint("merge"), "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("distance"))


def reachable(edges: DataFrame, root, target) -> DataFrame:
    """One row: can `target` be reached from `root`?"""
    return distances(edges, root).where(F.col("node") == target).agg(F.coalesce(F.max(F.col("distance") >= 0), F.lit(False)).alias("reachable"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component.

    Alternates two steps until the edges are stars around their smallest node: link every
    larger neighbour of a node to its smallest neighbour, then every smaller neighbour and
    the node itself. Both need only the minimum per node, so a hub is one aggregate row.
    """
    every = cut_lineage(vertices(edges))
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    links = cut_lineage(edges.select(hi.alias("u"), lo.alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Larger neighbours v of u move to the smallest of u's neighbourhood.
        large = both.where("v > u").join(smallest.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least.hint("merge"), F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return every.join(links.hint("merge"), F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(node, component, size)."""
    label = components(edges)
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return label.join(sizes, "component").select("node", "component", "size")


# How two ends of a walk lie to each other: the same side, opposite sides, or both, as a walk of odd length closes.
SAME, OPPOSITE, BOTH = 1, 2, 3


def _then(first: Column, second: Column) -> Column:
    """How the ends of two walks lie to each other, one walked after the other."""
    return F.when(first == SAME, second).when(second == SAME, first).when((first == OPPOSITE) & (second == OPPOSITE), F.lit(SAME)).otherwise(F.lit(BOTH))


def bipartite(edges: DataFrame) -> DataFrame:
    """(component, is_bipartite): no edge joins two nodes of the same colour.

    The rounds of `components`, logarithmically many however long the paths, with links that know
    whether a walk between their ends is even, odd or both. Links that fall together keep what
    either knew, so an odd cycle shows as a link of both kinds. A round's links are stored as
    files, which take a fraction of a checkpoint's room, and deleted when the next are stored.
    """
    spark = edges.sparkSession
    ends = F.array("src", "dst")  # one type for both
    edges, gone = _kept(edges.select(ends[0].alias("src"), ends[1].alias("dst")), "bipartite-edges")
    loops = cut_lineage(edges.where(F.col("src").eqNullSafe(F.col("dst"))).select(F.col("src").alias("node")).distinct())
    nulls = not edges.where("src is null or dst is null").isEmpty()
    if nulls:  # wrapped, a null is a node like any other
        edges, loops = (df.select(*[F.struct(F.col(c).alias("node")).alias(c) for c in df.columns]) for df in (edges, loops))
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    links, path = _kept(edges.select(hi.alias("u"), lo.alias("v")).where("u <> v").distinct().withColumn("sides", F.lit(OPPOSITE)), "bipartite-links")
    remove(spark, gone)

    def merged(rows: DataFrame) -> tuple[DataFrame, str]:
        return _kept(rows.groupBy("u", "v").agg(F.bit_or("sides").alias("sides")), "bipartite-links")

    def nearest(rows: DataFrame) -> DataFrame:
        """Of each node u the smallest end of its links as m, and how it lies."""
        return rows.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.min_by("sides", "v").alias("s")).hint("merge")

    mark = None
    while True:
        back = links.select(F.col("v").alias("u"), F.col("u").alias("v"), "sides")
        # Larger neighbours v of u move to the smallest of u's neighbourhood.
        far = back.join(nearest(links.unionByName(back)), F.col("u") == F.col("k"))
        own = F.col("m") > F.col("u")
        large, between = merged(far.select(F.col("v").alias("u"), F.when(own, F.col("u")).otherwise(F.col("m")).alias("v"), F.when(own, F.col("sides")).otherwise(_then(F.col("sides"), F.col("s"))).alias("sides")))
        remove(spark, path)
        # Then the smaller ones and u itself move to the smallest of them.
        near, top = large.join(nearest(large), F.col("u") == F.col("k")), F.col("v") == F.col("m")
        links, path = merged(near.select(F.when(top, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.when(top, F.col("sides")).otherwise(_then(F.col("sides"), F.col("s"))).alias("sides")))
        remove(spark, between)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v", "sides").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    met = links.select(F.col("v").alias("component"), (F.col("sides") == BOTH).alias("met"))
    looped = loops.join(links.hint("merge"), F.col("node") == F.col("u"), "left").select(F.coalesce("v", "node").alias("component"), F.lit(True).alias("met"))
    found = met.unionByName(looped).groupBy("component").agg((~F.bool_or("met")).alias("is_bipartite"))
    return found.select(F.col("component")["node"].alias("component"), "is_bipartite") if nulls else found


def _kept(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`df` as a stored table, and its folder."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of a DAG: the length of the longest path to the node.

    Ordering by (level, node) is a topological order. Nodes are peeled round by round when
    all their predecessors are done, so every edge is used once. Raises on a cycle.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("n")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("n")))
    waiting = cut_lineage(edges.select(F.inline(ends)).groupBy("node").agg(F.sum("n").alias("n")))
    done = None
    level = 0
    while True:
        ready = cut_lineage(waiting.where("n = 0").select("node", F.lit(level).alias("level")))
        rows = ready.count()
        if not rows:
            break
        done = ready if done is None else done.unionByName(ready)
        if level % FLATTEN == FLATTEN - 1:
            done = cut_lineage(done)
        used = _ahead(ready, rows, edges).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("used"))
        waiting = cut_lineage(
            waiting.where("n > 0").join(used.hint("merge"), "node", "left").select("node", (F.col("n") - F.coalesce("used", F.lit(0))).alias("n")))
        level += 1
    if not waiting.isEmpty():
        raise ValueError("the graph has a cycle")
    return done


def _top(best: DataFrame) -> DataFrame:
    """(c, o): the top of each node's tree, from every node's first edge c -> o.

    With distinct numbers the edges lead to one pair of nodes that chose the same edge; its
    smaller node is the top. Every node's pointer is replaced by its target's until none moves.
    The tables are stored as files: a checkpoint hands on what Spark has inferred of the columns,
    which grows with every join of a table to itself.
    """
    then = lambda df: df.select(F.col("c").alias("o"), F.col("o").alias("oo")).hint("merge")
    pairs = best.select("c", "o").join(then(best), "o")
    up = materialise(pairs.select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("o")), "tops")
    while True:
        far = materialise(up.join(then(up), "o").select("c", F.col("oo").alias("o"), (F.col("o") != F.col("oo")).alias("moved")), "tops")
        up = far.select("c", "o")
        if far.where("moved").isEmpty():
            return up


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """Edges of a minimum spanning forest.

    Edges are numbered once from the cheapest (ties by the end points). Each round every
    component takes its first outgoing edge, and the components joined by those edges are
    merged into one node; of the edges between two nodes only the first is kept, so the
    table shrinks every round. Only numbers travel: end points are looked up at the end.
    """
    edges = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    edges = cut_lineage(global_row_number(edges, [F.col("weight"), F.col("src"), F.col("dst")], "id"))
    open_ = edges.select("id", F.col("src").alias("a"), F.col("dst").alias("b"))
    picked = None
    while not open_.isEmpty():
        sides = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))
        best = materialise(open_.select("id", F.inline(sides)).groupBy("c").agg(F.min("id").alias("id"), F.min_by("o", "id").alias("o")), "tree")
        picked = best.select("id") if picked is None else picked.unionByName(best.select("id"))
        into = _top(best)
        a, b = (into.select(F.col("c").alias(c), F.col("o").alias(f"c{c}")).hint("merge") for c in ("a", "b"))
        # Edges inside a component never come back.
        moved = open_.join(a, "a").join(b, "b").where("ca <> cb")
        open_ = materialise(moved.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min("id").alias("id")), "open")
    if picked is None:
        return edges.select("src", "dst", "weight")
    return edges.join(picked.distinct().hint("merge"), "id").select("src", "dst", "weight")


def shortest_paths(edges: DataFrame, root) -> DataFrame:
    """(node, distance, negative_cycle): weighted distance from `root`, null when unreachable.

    Only nodes whose distance improved last round are extended. When distances still
    improve after as many rounds as there are nodes, a negative cycle can be reached:
    the nodes it reaches have no distance and are flagged, the others keep theirs.
    """
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    every = cut_lineage(vertices(edges))
    limit = every.count()
    dist = moved = cut_lineage(every.where(F.col("node") == root).select("node", F.lit(0).cast("bigint").alias("distance")))
    rounds, rows = 0, moved.count()
    while rounds <= limit:
        reach = _ahead(moved, rows, edges).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        held = dist.select("node", F.col("distance").alias("held"))
        moved = cut_lineage(reach.join(held.hint("merge"), "node", "left").where("held is null or distance < held").select("node", "distance"))
        rows = moved.count()
        if not rows:
            break
        dist = cut_lineage(dist.join(moved.hint("merge"), "node", "left_anti").unionByName(moved))
        rounds += 1
    if rounds <= limit:
        return every.join(dist.hint("merge"), "node", "left").select("node", "distance", F.lit(False).alias("negative_cycle"))
    # What still improves lies on or behind a negative cycle, and each cycle has such a node: follow the edges from there.
    spoiled = fresh = moved.select("node")
    while rows:
        ahead = _ahead(fresh, rows, edges).select(F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(ahead.join(spoiled.hint("merge"), "node", "left_anti"))
        rows = fresh.count()
        spoiled = cut_lineage(spoiled.unionByName(fresh))
    marked = every.join(dist, "node", "left").join(spoiled.withColumn("__looped", F.lit(True)), "node", "left")
    looped = F.coalesce("__looped", F.lit(False))
    return marked.select("node", F.when(~looped, F.col("distance")).alias("distance"), looped.alias("negative_cycle"))


def tree_stats(edges: DataFrame, root) -> DataFrame:
    """(node, depth, size) of a rooted tree given as parent -> child edges.

    Jump pointers double their reach every round: with the ancestor 2^k above and the
    number of descendants nearer than 2^k known, both follow for 2^(k+1). So the rounds
    are the logarithm of the depth, also for a tree that is one long path.
    """
    nodes = edges.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(1).cast("bigint").alias("depth"))
    top = edges.limit(1).select(F.lit(root).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("depth"))
    state = cut_lineage(nodes.unionByName(top).withColumn("size", F.lit(1).cast("bigint")))
    while not state.where("up is not null").isEmpty():
        gained = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("gain"))
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        state = cut_lineage(
            state.join(jump.hint("merge"), "up", "left").join(gained.hint("merge"), "node", "left").select(
                "node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")))
    return state.select("node", "depth", "size")


def adjacency(edges: DataFrame, width: int = 100_000) -> DataFrame:
    """Sorted neighbour lists in blocks: (src, block, neighbours), block = dst div width.

    A list holds at most `width` neighbours, so a hub becomes many rows, not one huge one.
    """
    rows = edges.select("src", "dst").distinct().withColumn("block", F.expr(f"dst div {width}"))
    return rows.groupBy("src", "block").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
