"""Connected components by alternating large-star and small-star rounds.

Edges run from their greater to their lesser node. A round takes one aggregation, which
says of every node its least neighbour and its edges either way, and one plan for both
stars; each writes a checkpoint, so nothing runs twice. The driver keeps a record of every
task until the session ends, so stages are what a round is sparing with: ten without
hubs on check_h, a few more with them. Nothing but a few sums and 1,024 hubs of either end
a round reach the driver. Aggregations combine on the map side, so a hub with very many
edges costs one row per task there, and its edges meet their least neighbour where they
lie instead of in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, hot_above, local, measured


def _nodes(edges: DataFrame) -> tuple[DataFrame, dict]:
    """(x, m, below, above) of each node: m is the least of it and its neighbours, below and
    above count its edges to lesser and greater ones; with what all nodes come to."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("m"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.col("v").alias("m"), F.lit(0).alias("below")))
    nodes = edges.select(F.explode(ends).alias("end")).select("end.*").groupBy("x").agg(F.min("m").alias("m"), F.sum("below").alias("below"), F.sum(1 - F.col("below")).alias("above"))
    between = F.count(F.when((F.col("m") < F.col("x")) & (F.col("above") > 0), 1))
    return measured(nodes, edges=F.sum("below"), below=F.max("below"), above=F.max("above"), between=between)


def _large_star(edges: DataFrame, nodes: DataFrame, seen: dict) -> DataFrame:
    """u to the least neighbour of v, by v; repeated edges may come."""
    rows = edges.select("u", "v", F.lit(None).cast("long").alias("hub_m"), F.col("v").alias("key"))
    above = hot_above(seen["edges"])
    if seen["above"] > above:
        # A hub's edges need no meeting by v; they are dealt by u.
        hubs = local(nodes.where(F.col("above") > above).select(F.col("x").alias("hub"), F.col("m").alias("hub_m")))
        rows = edges.join(F.broadcast(hubs), F.col("v") == F.col("hub"), "left").select("u", "v", "hub_m", F.when(F.col("hub").isNull(), F.col("v")).otherwise(F.col("u")).alias("key"))
    between = nodes.where((F.col("m") < F.col("x")) & (F.col("above") > 0)).select("x", "m")
    met = rows.join(between, (F.col("key") == F.col("x")) & F.col("hub_m").isNull(), "left")
    return met.select("u", F.coalesce("hub_m", "m", "v").alias("v"))


def _small_star(edges: DataFrame, nodes: DataFrame, seen: dict) -> DataFrame:
    """u and its lesser neighbours to the least of these, by u. nodes are those of before the
    large star, which leaves as many edges to every u."""
    rows = edges.select("u", "v", F.lit(None).cast("long").alias("hub_m"), F.col("u").alias("key"))
    above = hot_above(seen["edges"])
    if seen["below"] > above:
        edges = checkpointed(edges.distinct())
        hubs = local(nodes.where(F.col("below") > above).select(F.col("x").alias("u")))
        least = local(edges.join(F.broadcast(hubs), "u").groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("hub_m")))
        rows = edges.join(F.broadcast(least), F.col("u") == F.col("hub"), "left").select("u", "v", "hub_m", F.when(F.col("hub").isNull(), F.col("u")).otherwise(F.col("v")).alias("key"))
    own = F.min("v").over(Window.partitionBy("key", F.col("hub_m").isNull()))
    least = rows.select("u", "v", F.coalesce("hub_m", own).alias("m"))
    both = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])
    return least.select(F.explode(both).alias("edge")).select("edge.*").where("u <> v").distinct()


def star_forest(edges: DataFrame) -> DataFrame:
    """edges(u, v) over longs -> (u, v): from every node but the least of its component to that."""
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        nodes, seen = _nodes(now)
        if not seen["edges"] or (seen["below"] == 1 and not seen["between"]):
            return now  # each has one edge, and to a node that has none to a lesser one
        if seen["between"]:
            now = _large_star(now, nodes, seen)
        if seen["below"] > 1:
            now = _small_star(now, nodes, seen)
        now = checkpointed(now)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) over longs -> (node, root): root is the least node reachable.

    Nodes without an edge don't appear. Null ends, self-loops and repeated edges are
    ignored; an empty table gives an empty one.
    """
    stars = star_forest(edges)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
