"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import derived, stage

MAX_ROUNDS = 60
#: Edges of a vertex from which on it is a hub, and hubs that may be broadcast.
HUB_EDGES, HUBS = 200_000, 500_000


def contracted(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(v, root) after a few rounds: root is some smaller vertex of v's component, if v has one."""
    now = _ordered(edges)
    for k in range(rounds):
        now = stage(_round(now, edges.count() if k == 0 else now.count()), "stars", instead_of=(now,) if k else ())
    return derived(now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root")), now)


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots themselves; root is the smallest.

    Vertices are of any one type that Spark orders.  Repeats a round of two steps
    until nothing changes: every vertex hands its larger neighbours to its
    smallest one, then its smaller ones.  Minima are combined before they are
    shuffled and no vertex's neighbours are gathered; the edges of hubs are
    joined where they lie, not shuffled to one task.  With too few edges for a hub
    a window finds the smallest neighbours instead: the same round in a third of
    the shuffles, with a plan of which the driver keeps less.  Each round is
    written to the shared folder.
    """
    now = stage(_ordered(edges).distinct(), "edges")
    state = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = stage(_round(now, state[0]), "stars", instead_of=(now,))
        was, state = state, _fingerprint(now)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return derived(now.select(F.col("a").alias("v"), F.col("b").alias("root")), now)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _with_least(edges: DataFrame, least: DataFrame, hub_edges: int) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``least`` (u, m, degree) for their a."""
    # a vertex counts its edges, so there are at most edges / hub_edges hubs
    hubs = F.broadcast(least.where(F.col("degree") >= hub_edges).select("u", "m"))
    plain = edges.join(hubs, F.col("a") == F.col("u"), "left_anti").join(least.where(F.col("degree") < hub_edges).select("u", "m"), F.col("a") == F.col("u"))
    return plain.unionByName(edges.join(hubs, F.col("a") == F.col("u")))


def _round(now: DataFrame, count: int) -> DataFrame:
    """Every vertex hands its larger neighbours to its smallest one, then its smaller ones."""
    if 2 * count < HUB_EDGES:  # no vertex is a hub
        return _small_round(now)
    hub_edges = max(HUB_EDGES, 2 * count // HUBS)
    both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree"))
    large = _with_least(both.where("b > a"), least, hub_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    small = _with_least(large, least, hub_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("u", "m")).distinct()


def _small_round(now: DataFrame) -> DataFrame:
    """A round over edges so few that all of a vertex may be in one task."""
    of_vertex = Window.partitionBy("a")
    both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = both.withColumn("m", F.least(F.min("b").over(of_vertex), "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    handed = large.withColumn("m", F.min("b").over(of_vertex))
    ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return handed.select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)).first())
