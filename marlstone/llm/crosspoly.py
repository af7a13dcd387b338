"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A vector, padded to a power of two and rotated by three rounds of random signs
and Hadamard transforms, hashes to the nearest signed axis.  ``k`` such hashes
make a bucket; every vector enters its own bucket and the ``PROBES - 1`` next
likeliest ones in each table.  ``k`` follows from the number of distinct vectors,
so that chance meetings per row stay few at any size, and the number of tables
grows with ``k``, so that recall stays (0.99 at least, see the tests).

Vectors that share a bucket are candidates; every link is verified by its cosine
in double precision (at least ``COSINE``).  Candidates are first verified against
a few random centres of their buckets, which contracts groups of near copies;
then all pairs still apart are verified.  Links only join vectors of one
component, so ``n_links`` is counted exactly within each component, in tiles of
``TILE`` by ``TILE`` vectors, and no pair of a group is ever a row.  A cosine too
near the bound for a matrix product's rounding is summed exactly, so both steps
decide alike.

Exact copies are one vertex with a multiplicity.  Vectors that are null, empty,
zero or hold null or non-finite components link with nothing and are their own
component.  Vectors of different length never link.  A null vec_id counts as a
linked vector but names no component; its ``kept`` is false.  Repeated rows
count as copies.  Vectors are equal if 128 hashed bits are.  Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage
from .graph import components

COSINE = 0.95
TABLES, PROBES = 8, 6
#: Tables more for each hash beyond the fourth.
MORE_TABLES = 5
#: Buckets wanted per entry of a table.
ROOM = 8
CENTRES = 3
TILE, SLAB = 2048, 512
#: Distance from the bound within which a cosine is summed exactly.
NEAR = 1e-9
SEED = 97


def hashes_for(n: int, dims: int) -> int:
    """Hashes in a bucket so that a table has ``ROOM`` buckets per entry."""
    return max(2, int(np.ceil(np.log(max(2, n) * PROBES * ROOM) / np.log(2 * dims))))


def tables_for(k: int) -> int:
    return TABLES + MORE_TABLES * max(0, k - 4)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of every row, in place; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        a = y[:, :, 0] + y[:, :, 1]
        y[:, :, 1] = y[:, :, 0] - y[:, :, 1]
        y[:, :, 0] = a
        step *= 2
    return x


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, seed, x.shape[1]))
    x = x.copy()
    for _ in range(3):
        x *= rng.choice(np.float32([-1, 1]), x.shape[1])
        hadamard(x)
        x /= np.sqrt(x.shape[1])
    return x


def buckets(vectors: np.ndarray, k: int) -> np.ndarray:
    """Bucket keys (n, tables, PROBES) of unit rows."""
    n, dims = vectors.shape
    width = max(2, 1 << int(np.ceil(np.log2(max(2, dims)))))
    x = np.zeros((n, width), np.float32)
    x[:, :dims] = vectors
    out = np.zeros((n, tables_for(k), PROBES), np.uint64)
    rows = np.arange(n)[:, None]
    keep = min(3, width)
    with np.errstate(over="ignore"):
        for t in range(tables_for(k)):
            axes, losses = [], []
            for j in range(k):
                y = rotated(x, t * 64 + j)
                size = np.abs(y)
                top = np.argpartition(-size, keep - 1, axis=1)[:, :keep]
                top = top[rows, np.argsort(-size[rows, top], axis=1)]
                best = size[rows, top]
                axes.append(2 * top + (y[rows, top] < 0))
                losses.append((best[:, :1] - best) ** 2)
            # one axis replaced by its second or third, or two by their seconds
            options = [()] + [((j, r),) for j in range(k) for r in range(1, keep)]
            options += [((i, 1), (j, 1)) for i in range(k) for j in range(i)]
            loss = np.stack([sum((losses[j][:, r] for j, r in o), np.zeros(n)) for o in options], axis=1)
            keys = []
            for o in options:
                at = dict(o)
                key = np.full(n, t * 1_000_003 + dims, np.uint64)
                for j in range(k):
                    key = (key ^ axes[j][:, at.get(j, 0)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                keys.append(key)
            keys = np.stack(keys, axis=1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
            out[:, t, : order.shape[1]] = keys[rows, order]
            out[:, t, order.shape[1] :] = keys[:, :1]
    return out


def unit(vector: np.ndarray) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _entries(k_by_dims: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [unit(v) for v in frame["embedding"]]
            lengths = np.array([len(v) for v in vectors])
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                for part in np.array_split(own, -(-len(own) // 1024)):
                    keys = buckets(np.stack([vectors[i] for i in part]).astype(np.float32), k_by_dims[int(dims)])
                    vid = np.repeat(frame["vid"].to_numpy()[part], keys.shape[1] * keys.shape[2])
                    yield pd.DataFrame({"bucket": keys.reshape(-1).astype(np.int64), "vid": vid})

    return run


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` are linked to which of ``y`` (unit rows)."""
    cosine = x @ y.T
    out = cosine >= COSINE
    for i, j in zip(*np.nonzero(np.abs(cosine - COSINE) < NEAR), strict=True):
        out[i, j] = math.fsum(x[i] * y[j]) >= COSINE
    return out


def _close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = [len(x) == len(y) and bool(linked(unit(x)[None], unit(y)[None])[0, 0]) for x, y in zip(frame["x"], frame["y"], strict=True)]
        yield frame.loc[np.array(keep, bool), ["a", "b"]]


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of each vector to those of the other side of the tile; both sides if it lies on the diagonal."""
    vectors, n, vid = np.stack([unit(v) for v in frame["embedding"]]), frame["m"].to_numpy(), frame["vid"].to_numpy()
    left, right = np.flatnonzero(frame["side"].to_numpy() <= 0), np.flatnonzero(frame["side"].to_numpy() >= 0)
    diagonal = len(left) == len(right) == len(frame)
    links = np.zeros(len(frame), np.int64)
    for first in range(0, len(left), SLAB):
        some = left[first : first + SLAB]
        near = linked(vectors[some], vectors[right])
        if diagonal:
            near[np.arange(len(some)), some] = False
        else:
            links[right] += near.T @ n[some]
        links[some] += near @ n[right]
    return pd.DataFrame({"vid": vid, "links": links})


def _verified(pairs: DataFrame, distinct: DataFrame, label: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    x = distinct.select(F.col("vid").alias("a"), F.col("embedding").alias("x"))
    y = distinct.select(F.col("vid").alias("b"), F.col("embedding").alias("y"))
    return stage(pairs.join(x, "a").join(y, "b").mapInPandas(_close, "a long, b long"), label, instead_of)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``df``: id, n_links, component_id, kept."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    plain = F.transform(v, lambda x: x.cast("double") + 0.0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(sound, F.xxhash64(plain)).alias("h1"), F.when(sound, F.xxhash64(F.lit(SEED), plain)).alias("h2"), v.alias("embedding"))
    distinct = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("m"), F.min("id").alias("least"))
    # written once, so the ids stay
    distinct = stage(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    sizes = {r["d"]: r["count"] for r in distinct.groupBy(F.size("embedding").alias("d")).count().collect()}
    entries = distinct.select("vid", "embedding").mapInPandas(_entries({d: hashes_for(n, d) for d, n in sizes.items()}), "bucket long, vid long")
    entries = stage(entries.distinct(), "bucket-entries")
    # what is one row a bucket is written before it is joined, so that Spark can split a hot bucket
    full = stage(entries.groupBy("bucket").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi")).where("lo < hi").select("bucket"), "full-buckets")
    entries = stage(entries.join(full, "bucket", "left_semi"), "shared-buckets", instead_of=(entries, full))

    drawn = [F.min(F.struct(F.xxhash64("vid", F.lit(seed)).alias("h"), "vid"))["vid"].alias(f"c{seed}") for seed in range(CENTRES)]
    centres = stage(entries.groupBy("bucket").agg(*drawn), "bucket-centres")
    near = None
    for seed in range(CENTRES):
        centre = centres.select("bucket", F.col(f"c{seed}").alias("c"))
        best = entries.join(centre, "bucket").where("vid <> c").groupBy("vid", "c").count()
        best = best.groupBy("vid").agg(F.max(F.struct("count", "c")).alias("m")).select(F.greatest("vid", "m.c").alias("a"), F.least("vid", "m.c").alias("b"))
        near = best if near is None else near.union(best)
    first = _verified(near.distinct(), distinct, "centre-links", (centres,))
    roots = components(first)
    labelled = stage(entries.join(roots, F.col("vid") == F.col("v"), "left").select("bucket", "vid", F.coalesce("root", "vid").alias("root")), "labelled-buckets", instead_of=(entries, roots))
    apart = stage(labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"), "open-buckets")
    open_ = labelled.join(apart, "bucket", "left_semi")
    a = open_.select("bucket", F.col("vid").alias("a"), F.col("root").alias("ra"))
    b = open_.select("bucket", F.col("vid").alias("b"), F.col("root").alias("rb"))
    pairs = a.join(b, "bucket").where("a > b and ra <> rb").select("a", "b").distinct()
    second = _verified(pairs, distinct, "open-links", (labelled, apart))
    roots = components(first.union(second))

    placed = distinct.join(roots, F.col("vid") == F.col("v"), "left").select("vid", "h1", "h2", "embedding", "m", "least", F.coalesce("root", "vid").alias("root"))
    groups = placed.groupBy("root").agg(F.count("*").alias("members"), F.min("least").alias("component_id"))
    groups = stage(groups, "vector-groups")
    many = placed.join(groups.where("members > 1").select("root", F.ceil(F.col("members") / TILE).cast("int").alias("blocks")), "root")
    block = many.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    spread = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.signum(F.col("block") - F.col("other")).cast("int").alias("side"), "vid", "m", "embedding",
    )
    links = spread.groupBy("root", "i", "j").applyInPandas(_tile, "vid long, links long").groupBy("vid").agg(F.sum("links").alias("links"))
    known = placed.select("vid", "h1", "h2", "root", "m").join(groups.select("root", "component_id"), "root").join(links, "vid", "left")
    known = stage(known.select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "vector-links")
    out = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


#: All pairs, for small tables; ids are unique there.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
c(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.vec_id),
g AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY 1)
SELECT g.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, g.vec_id = component_id AS kept FROM g LEFT JOIN n ON n.a = g.vec_id
"""
