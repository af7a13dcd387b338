"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a key: the hash of the text, then the id, then a number
that tells repeated rows apart; so equal texts stand together.  A size-weighted
sample of the keys gives quantile boundaries; records are range-partitioned
between them; ranges found overfull by an exact count are subdivided by a finer
sample of their own.  The exact bytes and rows of every range then give each
record its position in the total order, which decides shard and slot: shard
boundaries cut the order at equal bytes, so a shard is off by less than one
record, and slots run gapless from 0.  Samples decide only how the work is
dealt, never a shard or a slot.

Only the splitters and the per-range totals, whose number the parameters bound,
reach the driver.  No window spans more than a range, and a group of equal texts,
or of repeated rows, is split at range boundaries however large it is.

Null texts have the hash of null and size 8; null ids order first.  Repeated
rows are interchangeable and each keep a place.  An empty table gives an empty
result.  Columns of the input pass through, whatever their names, unless this
operator adds one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stage, unsigned_crc32

SHARDS = 24
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 32
#: A range with more than this many times the mean bytes or rows is subdivided.
OVERFULL = 2.0
KEY = ("hash", "id", "unique")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def _uniform(*cols: Column) -> Column:
    """In (0, 1], from a hash, so that reruns and retries draw the same sample."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(1)) / F.lit(float(2**53))


def _sampled(keys: DataFrame, unit: Column, seed: int) -> DataFrame:
    """Keys drawn in proportion to size, one for every ``unit`` bytes, with the weight each stands for."""
    drawn = keys.where(_uniform(*KEY, F.lit(seed)) <= F.col("size") / unit)
    return drawn.withColumn("w", F.greatest(F.col("size").cast("double"), unit))


def _quantiles(drawn: list, pieces: int) -> list[tuple]:
    """At most ``pieces - 1`` keys that cut the sample's weight evenly."""
    drawn = sorted(drawn, key=lambda r: tuple(r[c] for c in KEY))
    mass, seen, out = sum(r["w"] for r in drawn), 0.0, []
    for r in drawn:
        key = tuple(r[c] for c in KEY)
        if seen >= mass * (len(out) + 1) / pieces and (not out or out[-1] < key):
            out.append(key)
        seen += r["w"]
    return out[: pieces - 1]


def _range_of(splitters: list[tuple]) -> Column:
    """The number of splitters at or below the key, found in two short scans."""
    pair = lambda s: F.struct(*[F.lit(x).cast("bigint") for x in s])
    key = F.struct(*KEY)
    if not splitters:
        return F.lit(0)
    width = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    coarse = F.size(F.filter(F.array(*[pair(g[0]) for g in groups]), lambda s: s <= key))
    fine = F.get(F.array(*[F.array(*map(pair, g)) for g in groups]), F.greatest(coarse - 1, F.lit(0)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda s: s <= key)))


def _splitters(keys: DataFrame, total: int, rows: int, ranges: int, seed: int) -> list[tuple]:
    """Boundaries of about ``ranges`` ranges, none of which is overfull unless by one record."""
    unit = F.lit(total / (ranges * SAMPLES_PER_RANGE))
    splitters = _quantiles(_sampled(keys, unit, seed).collect(), ranges)
    held = keys.groupBy(_range_of(splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    pieces = {r["r"]: max(r["b"] * ranges / total, r["n"] * ranges / rows) for r in held}
    pieces = {r: round(k) for r, k in pieces.items() if k > OVERFULL}
    if pieces:
        # rows, too, weigh here: small records may overfill a range; the pieces add up to two for each range at most
        heavy = F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv])
        mixed = (F.col("size") * F.lit(ranges / total) + F.lit(ranges / rows)) / 2
        inside = keys.withColumn("r", _range_of(splitters)).withColumn("pieces", heavy[F.col("r")]).where("pieces is not null").withColumn("size", mixed)
        drawn: dict[int, list] = {}
        for r in _sampled(inside, F.lit(1 / SAMPLES_PER_RANGE), seed + 1).collect():
            drawn.setdefault(r["r"], []).append(r)
        splitters = sorted({*splitters, *(s for r, rs in drawn.items() for s in _quantiles(rs, pieces[r]))})
    return splitters


def _keyed(df: DataFrame, kept: list[Column], id_col: str, text_col: str) -> DataFrame:
    """What is kept of each record as ``row``, beside its key and size; written, so the numbers stay."""
    return stage(df.select(
        F.struct(*kept).alias("row"),
        F.xxhash64(text_col).alias("hash"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"),
        F.monotonically_increasing_id().alias("unique"),
        record_size(F.col(text_col)).alias("size"),
    ), "shard-records")


def _assigned(keyed: DataFrame, shards: int, seed: int) -> DataFrame:
    """``keyed`` with shard and slot."""
    spark, keys = keyed.sparkSession, keyed.select(*KEY, "size")
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    splitters = _splitters(keys, total, rows, shards * RANGES_PER_SHARD, seed) if rows else []
    placed = lambda d: d.withColumn("r", _range_of(splitters).cast("int"))

    totals = placed(keys).groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    offsets, at_bytes, at_rows = [], 0, 0
    for r in sorted(totals, key=lambda r: r["r"]):
        offsets.append((r["r"], at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r["b"], at_rows + r["n"]
    # bounded by the number of ranges, whatever the input
    before = F.broadcast(spark.createDataFrame(offsets, "r int, b0 bigint, n0 bigint"))

    def positioned(d: DataFrame) -> DataFrame:
        w = Window.partitionBy("r").orderBy(*KEY)
        d = placed(d).join(before, "r")
        end = F.col("b0") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("end", end).withColumn("position", F.col("n0") + F.row_number().over(w) - 1)
        middle = F.expr(f"(end * 2 - size) * {shards}L div {max(1, 2 * (total or 0))}L")
        return d.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))

    firsts = [(r[0], r[1]) for r in positioned(keys).groupBy("shard").agg(F.min("position")).collect()]
    first = F.broadcast(spark.createDataFrame(firsts, "shard int, first bigint"))
    return positioned(keyed).join(first, "shard").withColumn("slot", F.col("position") - F.col("first"))


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Add ``size``, ``law``, ``shard`` and ``slot``."""
    out = _assigned(_keyed(df, [F.col(f"`{c}`") for c in df.columns], id_col, text_col), shards, seed)
    added = {"size": F.col("size"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": F.col("slot")}
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in added]
    return out.select(*kept, *[v.alias(k) for k, v in added.items()])


def shard_digest(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per record: id, size, checksum, law, shard and slot, without the text."""
    kept = [F.col("doc_id"), unsigned_crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")]
    out = _assigned(_keyed(df, kept, "doc_id", "text"), shards, 17)
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
