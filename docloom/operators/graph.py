"""Graph operators on edge tables: bounded traversal, components, label propagation, cycles.

Edges are (src, dst) rows. Iterations are joins; lineage is cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions, without loops and null ends; of parallel edges the greatest weight."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst", w.alias("weight"))
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def bounded_bfs(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hop): nodes within ``hops`` undirected steps of a seed, with the fewest steps.

    Every step joins the newest nodes only, against edges that were made
    undirected once.
    """
    both = cut_lineage(undirected(edges).select("src", "dst"))
    seen = seeds.select(F.col("node")).where("node IS NOT NULL").distinct().withColumn("hop", F.lit(0))
    newest = seen
    for hop in range(1, hops + 1):
        reached = newest.join(both, newest["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        newest = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(newest)
    return seen


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): connected components, named by their smallest node.

    Alternating large-star and small-star steps: each node sends its larger
    neighbours, then its smaller ones, to the smallest node it knows. Rounds are
    logarithmic, rows never exceed the edges, and the minimum per node is a
    partial aggregate, so a node with a third of all edges is no large group.
    Nodes whose only edges are loops are their own components. A graph that is
    not done after ``rounds`` rounds is an error, never a partial result.
    """
    loops = edges.where("src IS NOT NULL AND src = dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    nodes = cut_lineage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(loops.select("u")).distinct())
    pairs, before = cut_lineage(pairs), None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(linked.where("u <> v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not converged after {rounds} rounds")
    root = pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(node, label): every round each node takes the label with the greatest total weight among its neighbours.

    Ties go to the smaller label, and a node keeps its own where that is among
    the best. All nodes change together: the synchronous form, which unlike a
    sweep in node order runs as one join per round.
    """
    both = cut_lineage(undirected(edges))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src"), F.col("label")).agg(F.round(F.sum("weight"), 6).alias("votes"))
        own = labels.select(F.col("node").alias("src"), F.col("label").alias("mine"))
        w = Window.partitionBy("src").orderBy(F.desc("votes"), F.desc((F.col("label") == F.col("mine")).cast("int")), "label")
        best = votes.join(own, "src").withColumn("place", F.row_number().over(w)).where("place = 1")
        labels = cut_lineage(best.select(F.col("src").alias("node"), "label"))
    return labels


def short_cycles(edges: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that point to each other, a < b."""
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return rows.groupBy("a", "b").agg(F.bool_or("up").alias("x"), F.bool_or(~F.col("up")).alias("y")).where("x AND y").select("a", "b")


def bounded_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(nodes, length): every directed cycle of up to ``longest`` edges, once, from its smallest node on.

    Loops are cycles of length 1. Paths grow by one join a step; they begin at
    their smallest node and never return to one they have, and nodes without an
    edge in or out are removed first, so only what may still close is carried.
    """
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    loops = rows.where("src = dst").select(F.array("src").alias("nodes"))
    live = cut_lineage(rows.where("src <> dst"))
    for _ in range(2):
        live = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    live = cut_lineage(live.select("src", "dst"))
    paths = live.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"))
    found = loops
    for length in range(2, longest + 1):
        step = paths.join(live, paths["last"] == live["src"]).select("first", "dst", "nodes")
        closed = step["dst"] == step["first"]
        more = (step["dst"] > step["first"]) & ~F.array_contains("nodes", step["dst"])
        step = cut_lineage(step.where(closed | (more if length < longest else F.lit(False))))
        found = found.unionByName(step.where("dst = first").select("nodes"))
        paths = step.where("dst <> first").select("first", F.col("dst").alias("last"), F.array_append("nodes", F.col("dst")).alias("nodes"))
    return found.select("nodes", F.size("nodes").alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over distinct edges without loops."""
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    ends = rows.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
