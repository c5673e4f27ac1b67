"""Connected components of a link table, for links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, written_at
from .common import HOT, in_few_tasks


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, root) for every end of links (a, b), two columns of one type that has an order: root is the least id of the component.

    Each round points every node of an edge at the smallest node near it, by the two star operations for MapReduce
    (Kiveris and others, 2014): large-star links larger neighbours to the least neighbour, small-star the smaller ones.
    Both keep components; the edges become stars in a logarithmic number of rounds. A hot node's neighbours are only
    counted and minimised, which combines before the shuffle; what is found for hot nodes, of which there are few, is
    broadcast to their edges, so no task holds a hub's. Large-star makes no more edges than it gets, so what it repeats goes
    with what small-star repeats. The edges of each half of a round are written to the shared folder, and those before them go."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, folder = written_at(edges, "links")
    total = edges.count()
    for _ in range(rounds):
        if _are_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large, between = written_at(in_few_tasks(large, total), "large-star")  # else each of its uses below would plan it again
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        old = folder
        edges, folder = written_at(in_few_tasks(small, total), "links")
        remove(links.sparkSession, old, between)
        total = edges.count()
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("id"), "root").distinct())


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with m, as least has it of each u. What hot nodes have is broadcast once, for their edges and to leave them out of
    the shuffle of the others."""
    hot = F.broadcast(least.where(F.col("n") * HOT > total).select("u", F.col("m").alias("of_hot")))
    told = edges.join(hot, "u", "left")
    rest = told.where("of_hot is null").select("u", "v").join(least.where(F.col("n") * HOT <= total).select("u", "m"), "u")
    return told.where("of_hot is not null").select("u", "v", F.col("of_hot").alias("m")).union(rest)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each upper end u of distinct edges (u, v) stands in one edge and is no lower end: then v is the least of all
    that hang together with u, and another round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))).alias("e"))
    of_each = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.low").alias("low"))
    return of_each.where("up > 1 or (up = 1 and low = 1)").isEmpty()
