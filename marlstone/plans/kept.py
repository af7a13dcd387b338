"""Counts kept with a version, so that questions about the whole corpus read no notes.

``counts`` holds, for each part, how often each name of a kind occurs.  Counts of
parts, and of the batches of a stream, add up; a refresh writes those of the
years that it parses and keeps the others.  ``sketches`` holds one mergeable
sketch of the targets for each part, for an estimate of how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.analytics import by_name
from ..operators.search import UNDATED, part_of

#: Kinds of names: of reports (date, year), of blocks (institution, tag), of mentions (coverage, target, key).
DATE, YEAR, INSTITUTION, TAG, COVERAGE, TARGET, KEY = "date", "year", "institution", "tag", "coverage", "target", "key"
#: Registers of a sketch, as a power of two; its standard error is 1.04 / sqrt(2 ** 14), 0.8 %.
PRECISION = 14
SPREAD = 8


def _named(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def counts(reports: DataFrame, blocks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(part, kind, name, n); each table is read once.  Null names are counted too."""
    said = [
        (reports, F.array(_named(DATE, F.col("date")), _named(YEAR, F.col("year")))),
        (blocks, F.concat(F.array(_named(INSTITUTION, F.col("institution"))), F.transform("tags", lambda t: _named(TAG, t)))),
        (mentions, F.array(_named(COVERAGE, F.col("institution")), _named(TARGET, F.col("target_name")), _named(KEY, F.col("target_key")))),
    ]
    rows = [df.select(part_of(F.col("date")).alias("part"), F.explode(names).alias("t")).select("part", "t.*") for df, names in said]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("part", "kind", "name").agg(F.count("*").alias("n"))


def dealt(kept: DataFrame) -> DataFrame:
    """``counts`` as they are written: a kind of a part is in a few files, whatever the number of tasks."""
    return kept.repartition("part", "kind", F.pmod(F.xxhash64("name"), F.lit(SPREAD)))


def sketches(kept: DataFrame) -> DataFrame:
    """(part, sketch) of the targets; a name counts once for its part, so only ``counts`` are read."""
    return kept.where((F.col("kind") == KEY) & F.col("name").isNotNull()).groupBy("part").agg(F.hll_sketch_agg("name", PRECISION).alias("sketch"))


def top(kept: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """``analytics.count_by`` of a kind's names."""
    rows = kept.where((F.col("kind") == kind) & (F.col("name") != "")).groupBy("name").agg(F.sum("n").alias("count"))
    out = rows.orderBy(F.desc("count"), by_name("name"), "name")
    return out.limit(limit) if limit else out


def totals(kept: DataFrame) -> Row:
    """How many reports, mentions and targets there are, and the latest date."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    number = lambda kind: F.coalesce(F.sum(of(kind, F.col("n"))), F.lit(0))
    return kept.where(F.col("kind").isin(DATE, KEY)).agg(
        number(DATE).alias("reports"), number(KEY).alias("mentions"), F.count_distinct(of(KEY, F.col("name"))).alias("targets"),
        F.max(F.when(F.col("part") != UNDATED, of(DATE, F.col("name")))).alias("latest"),
    ).first()


def _of_years(df: DataFrame, years: Sequence[str] | None) -> DataFrame:
    return df if years is None else df.where(F.col("part").isin(list(years)))


def distinct_targets(kept: DataFrame, years: Sequence[str] | None = None) -> int:
    return _of_years(kept, years).where(F.col("kind") == KEY).agg(F.count_distinct("name")).first()[0]


def about_distinct_targets(sketched: DataFrame, years: Sequence[str] | None = None) -> int:
    """An estimate from one sketch for each part."""
    return _of_years(sketched, years).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))).first()[0]
