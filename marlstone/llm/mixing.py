"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in ``target / source_size`` copies.
The expected copies are summed along an order of the source's documents, one
random offset is added, and a document is emitted once for each integer the sum
crosses.  The order runs through bands of similar size, so the words taken, not
only the documents, come near the target.

The running sum needs only a document's rank within its source: bands of a
source are split into cells of a few hundred documents by a hash, the cells'
counts are summed first, and no window spans more than a cell, however large a
source is.  Repeated rows are ranked as one block; the block's copies are dealt
evenly to its rows, which are numbered within the partitions where they lie.
Only sizes and hashes are written on the way; texts move once, to meet the copies
that their documents are given.
All arithmetic on ranks is exact (integers and decimals), and offset and order
come from hashes, so reruns agree.

Null text has size 0; null sources form one source, ordered last.  Documents of
size 0 follow the same rule.  Repeated rows each have their own expected
copies.  An empty table gives an empty result.  ``mixed`` leaves every column of
the input as it is, whatever its name; ``mix`` replaces those of the names that
it adds.  The number of sources must stay below ``MAX_SOURCES``; beyond, an error
is raised and nothing is dropped.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, stage

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_COPIES = 2
CELL_ROWS = 256
MAX_SOURCES = 100_000
#: Ranks are multiplied by the rate in millionths of millionths.
SCALE = 10**12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: Fraction = SHARE, cap: int = MOST_COPIES) -> dict[str | None, Fraction]:
    """Words each source should give: by weight, none above ``cap`` times its size."""
    names = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size, weight = dict(sizes), {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(size.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > cap * size[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = Fraction(cap * size[s])
            left -= out[s]
        free -= full
    return out


def _keyed(df: DataFrame, kept: list[Column], id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """What is kept of each document as ``row``, beside what decides its copies."""
    return df.select(
        F.struct(*kept).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("tie"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` to every row."""
    added = ("size", "source_size", "target", "copies")
    out = _copies(_keyed(df, [F.col(f"`{c}`") for c in df.columns], id_col, text_col, source_col, seed), seed)
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in added], *added)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29) -> DataFrame:
    """The mix itself: the rows of ``df`` as often as they are taken, columns unchanged."""
    out = _copies(_keyed(df, [F.col(f"`{c}`") for c in df.columns], id_col, text_col, source_col, seed), seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def _copies(keyed: DataFrame, seed: int) -> DataFrame:
    """``keyed`` with source_size, target and copies."""
    spark = keyed.sparkSession
    band = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    blocks = keyed.groupBy("source", "size", "tie").agg(F.count("*").alias("rows")).withColumn("band", band)
    blocks = stage(blocks, "mix-blocks")

    held = stage(blocks.groupBy("source", "band").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("b"), F.count("*").alias("blocks")), "mix-bands")
    per_source = held.groupBy("source").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = targets([(r["source"], r["b"]) for r in per_source])
    rates = []
    for r in per_source:
        rate = want[r["source"]] / r["b"] if r["b"] else Fraction(0)
        rates.append((r["source"], r["b"], float(want[r["source"]]), int(rate * SCALE)))
    rates_df = F.broadcast(spark.createDataFrame(rates, "source string, source_size bigint, target double, rate bigint"))

    # written first: Spark sees its size and broadcasts it only if that is small, else it can split a hot band
    by_source = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = held.select("source", "band", F.ceil(F.col("blocks") / CELL_ROWS).cast("int").alias("cells"), F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("start"))
    bands = stage(bands, "mix-starts", instead_of=(held,))
    same = lambda *names: F.expr(" and ".join(f"l.{c} <=> r.{c}" for c in names))
    celled = blocks.alias("l").join(bands.alias("r"), same("source", "band")).select("l.*", "cells", "start")
    celled = celled.withColumn("cell", F.pmod("tie", "cells").cast("int"))
    by_band = Window.partitionBy("source", "band").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy("source", "band", "cell").agg(F.sum("rows").alias("n"))
    counts = counts.select("source", "band", "cell", F.coalesce(F.sum("n").over(by_band), F.lit(0)).alias("before"))

    in_cell = Window.partitionBy("source", "band", "cell").orderBy("size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.withColumn("within", F.coalesce(F.sum("rows").over(in_cell), F.lit(0)))
    ranked = ranked.alias("l").join(counts.alias("r"), same("source", "band", "cell")).select("l.*", (F.col("start") + F.col("before") + F.col("within")).alias("rank"))
    ranked = ranked.alias("l").join(rates_df.alias("r"), same("source")).select("l.*", "source_size", "target", "rate")
    shift = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(SCALE)).cast("decimal(38,0)")
    crossed = lambda n: F.floor((n.cast("decimal(20,0)") * F.col("rate").cast("decimal(15,0)") + shift) / F.lit(SCALE)).cast("bigint")
    taken = crossed(F.col("rank") + F.col("rows")) - crossed(F.col("rank"))
    # written first, so that Spark can split a hot block
    quota = stage(ranked.select("source", "size", "tie", "rows", taken.alias("copies"), "source_size", "target"), "mix-quota")

    # the quota has no bound, so it is never broadcast: the plan is one at every size
    given = lambda some: keyed.alias("l").join(some.hint("merge").alias("r"), same("source", "size", "tie")).select("l.*", "rows", "copies", "source_size", "target")
    plain = given(quota.where("rows = 1")).withColumn("copies", F.col("copies").cast("int")).drop("rows")
    if quota.where("rows > 1").isEmpty():
        return plain
    # of a block's rows, the first ones take one copy more where they cannot all take as many;
    # written, so the numbers stay
    several = stage(given(quota.where("rows > 1")).withColumn("unique", F.monotonically_increasing_id()), "mix-repeated")
    several = several.withColumn("place", F.shiftright("unique", 33))
    before = several.groupBy("source", "size", "tie", "place").agg(F.count("*").alias("n"))
    by_place = Window.partitionBy("source", "size", "tie").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "size", "tie", "place", F.coalesce(F.sum("n").over(by_place), F.lit(0)).alias("before"))
    in_place = Window.partitionBy("source", "size", "tie", "place").orderBy("unique")
    several = several.withColumn("n", F.row_number().over(in_place))
    several = several.alias("l").join(before.alias("r"), same("source", "size", "tie", "place")).select("l.*", "before")
    more = (F.col("before") + F.col("n") <= F.expr("copies % rows")).cast("int")
    several = several.withColumn("copies", (F.expr("copies div rows") + more).cast("int")).drop("rows", "place", "n", "before", "unique")
    return plain.unionByName(several)


def mix_digest(df: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken."""
    # sizes and hashes are taken from the texts once
    out = _copies(stage(_keyed(df, [F.col("doc_id"), F.col("source")], "doc_id", "text", "source", 29), "mix-documents"), 29)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
