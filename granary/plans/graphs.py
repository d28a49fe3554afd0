"""Graph queries over part, supplier and customer graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import graph as G
from granary.plans.duck import CTE, with_
from granary.plans.registry import query
from granary.sources import adapters as A

query("graph_lineage_downstream", with_("part_dag", """, r as (select cast(1 as bigint) as node, 0 as depth union select dst, depth+1 from r join part_dag on src=node)
select node, min(depth) as depth from r group by 1""", recursive=True))(lambda spark, root: G.lineage(A.part_dag(spark, root), 1))
query("graph_lineage_depth", with_("part_dag", """, r as (select cast(1 as bigint) as node, 0 as depth union select dst, depth+1 from r join part_dag on src=node where depth<3)
select node, min(depth) as depth from r group by 1""", recursive=True))(lambda spark, root: G.lineage(A.part_dag(spark, root), 1, max_depth=3))
query("graph_lineage_upstream", with_("part_dag", """, r as (select max(p_partkey) as node, 0 as depth from part union select src, depth+1 from r join part_dag on dst=node)
select node, min(depth) as depth from r group by 1""", recursive=True))(
    lambda spark, root: G.lineage(A.part_dag(spark, root), A.table(spark, root, "part").agg(F.max("p_partkey")).scalar(), upstream=True))

_BOTH = ", both_ways as (select src, dst, weight from supply_edges union all select dst, src, weight from supply_edges)"
query("graph_bfs_dist", with_("supply_edges", _BOTH + """, r as (select cast(1 as bigint) as node, 0 as d union select dst, d+1 from r join both_ways on src=node where d<12),
v as (select distinct src as node from both_ways)
select v.node, coalesce(min(d),-1) as distance from v left join r on r.node=v.node group by 1""", recursive=True))(
    lambda spark, root: G.distances(G.undirected(A.supply_edges(spark, root)), 1))


def reachable(spark: SparkSession, root: str) -> DataFrame:
    """Which parts can be reached from part 2 along the part graph."""
    return G.distances(A.part_dag(spark, root), 2).select("node", (F.col("distance") >= 0).alias("reachable"))


query("graph_reachable", with_("part_dag", """, r as (select cast(2 as bigint) as node union select dst from r join part_dag on src=node),
v as (select src as node from part_dag union select dst from part_dag) select v.node, r.node is not null as reachable from v left join r on r.node=v.node""", recursive=True))(reachable)
query("graph_components", with_("market_edges", """, m as (select dst, least(min(src), dst) as component, count(*)+1 as size from market_edges group by dst)
select src as node, component, size from market_edges e join m on m.dst=e.dst union select dst, component, size from m"""))(
    lambda spark, root: G.component_sizes(A.market_edges(spark, root)))


def bipartite(spark: SparkSession, root: str) -> DataFrame:
    """Two separate graphs: part - supplier (two-colourable) and the part graph (it has odd cycles)."""
    dag = A.part_dag(spark, root).where("src <> dst").select((F.col("src") + 3_000_000_000).alias("src"), (F.col("dst") + 3_000_000_000).alias("dst"))
    return G.bipartite(A.supply_edges(spark, root).select("src", "dst").unionByName(dag))


# Walks of both parities from the smallest node of either graph (both are connected); where both reach one node there is an odd cycle.
query("graph_bipartite", "with recursive " + CTE["supply_edges"] + ", " + CTE["part_dag"] + """,
g as (select src as a, dst as b from supply_edges union select dst, src from supply_edges union select src+3000000000, dst+3000000000 from part_dag where src<>dst
  union select dst+3000000000, src+3000000000 from part_dag where src<>dst),
walk as (select * from (select min(a) as node, min(a) as component, 0 as parity from g group by a >= 3000000000) q union select g.b, walk.component, 1-parity from walk join g on g.a=walk.node)
select component, count(*) = count(distinct node) as is_bipartite from walk group by 1""")(bipartite)
query("graph_topological_level", with_("part_dag", """, r as (select distinct src as node, 0 as level from part_dag where src not in (select dst from part_dag)
  union select dst, level+1 from r join part_dag on src=node) select node, max(level) as level from r group by 1""", recursive=True))(
    lambda spark, root: G.topological_levels(A.part_dag(spark, root)))
# Grown from one node, cheapest crossing edge first; the test graph is connected.
query("graph_mst", "with recursive " + CTE["supply_edges"].replace("supply_edges as (", "supply_edges as materialized (") + """,
r(node, src, dst, weight) using key (node) as (select min(src), cast(null as bigint), cast(null as bigint), cast(null as bigint) from supply_edges union (
  select case when a.node is null then e.src else e.dst end, e.src, e.dst, e.weight from supply_edges e left join recurring.r a on a.node=e.src left join recurring.r b on b.node=e.dst
  where (a.node is null) <> (b.node is null) order by e.weight, e.src, e.dst limit 1))
select src, dst, weight from r where src is not null""")(lambda spark, root: G.minimum_spanning_tree(A.supply_edges(spark, root)))
query("graph_sssp", with_("supply_edges", _BOTH + """, r as (select cast(1 as bigint) as node, cast(0 as bigint) as d union select dst, d+weight from r join both_ways on src=node where d+weight<=40),
v as (select distinct src as node from both_ways)
select v.node, min(d) as distance, false as negative_cycle from v left join r on r.node=v.node group by 1""", recursive=True))(
    lambda spark, root: G.shortest_paths(G.undirected(A.supply_edges(spark, root)), 1))
query("graph_tree_depth_size", with_("part_tree", """, r as (select dst as node, src as up, 1 as k from part_tree union all select r.node, t.src, k+1 from r join part_tree t on t.dst=r.up),
v as (select src as node from part_tree union select dst from part_tree), d as (select node, max(k) as depth from r group by 1), s as (select up, count(*) as n from r group by 1)
select v.node, cast(coalesce(depth,0) as bigint) as depth, coalesce(n,0)+1 as size from v left join d on d.node=v.node left join s on s.up=v.node""", recursive=True))(
    lambda spark, root: G.tree_stats(A.part_tree(spark, root), 1))
query("graph_degree_adjacency", with_("supply_edges", " select src, dst//50 as block, count(*) as n, string_agg(cast(dst as varchar), ',' order by dst) as neighbours from supply_edges group by 1,2"))(
    lambda spark, root: G.adjacency(A.supply_edges(spark, root), width=50).select("src", "block", F.size("neighbours").cast("bigint").alias("n"), F.array_join("neighbours", ",").alias("neighbours")))
