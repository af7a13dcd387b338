"""Questions about mentions: changes, matrix, divergence, counts, diffs, watch lists.

Functions take column names, so they run on mentions and on any table with a
key, an institution, a date and values.  Order by ``order`` columns is total;
every limit is taken under a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SEQ = ("file_path", "line_number", "match_no")


def detect_changes(
    rows: DataFrame, key: str = "target_key", institution: str = "institution", date: str = "date", rating: str = "rating",
    price: str = "target_price", action: str | None = "action", order: Sequence[str] = SEQ, keep: Sequence[str] = ("target_name", "report_id", "line_number"),
) -> DataFrame:
    """Rows that differ from the previous one of their key and institution, with both values.

    The first row of a key is its first coverage unless it carries an action; a
    row with an action always counts.  One shuffle, on (key, institution).
    """
    did = F.col(action) if action else F.lit(None).cast("string")
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    by_key = Window.partitionBy(key, institution).orderBy(date, *order)
    now = rows.where(given(rating) | given(price)).withColumns({
        "_n": F.row_number().over(by_key),
        "previous_rating": F.lag(rating).over(by_key),
        "previous_target_price": F.lag(price).over(by_key),
    })
    first = F.col("_n") == 1
    other_rating, other_price = ~F.col("previous_rating").eqNullSafe(F.col(rating)), ~F.col("previous_target_price").eqNullSafe(F.col(price))
    done = F.nullif(did, F.lit(""))
    kind = F.coalesce(done, F.when(first, F.lit("首次覆盖")).when(other_price, F.lit("目标价变化")).when(other_rating, F.lit("评级变化")).otherwise(F.lit("维持")))
    now = now.where(first | other_rating | other_price | done.isNotNull())
    names = dict.fromkeys([*keep, key, institution, date, *order])
    return now.select(*names, "previous_rating", F.col(rating).alias("current_rating"), "previous_target_price", F.col(price).alias("current_target_price"), kind.alias("change_type"))


def by_name(column: str) -> Column:
    """Names as people order them, not by code unit: case and accents count last.  For ordering only."""
    return F.collate(column, "UNICODE").asc()


def change_order(key: str = "target_key", institution: str = "institution", date: str = "date", order: Sequence[str] = SEQ, named=by_name) -> list[Column]:
    """Newest first; within a date by key, institution and place."""
    return [F.desc(date), named(key), named(institution), F.asc(key), F.asc(institution), *map(F.asc, order)]


def count_by(rows: DataFrame, name: Column, limit: int | None = None) -> DataFrame:
    """(name, count) by count, then name as people order names; blank names are skipped."""
    out = rows.select(name.alias("name")).where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("name").agg(F.count("*").alias("count"))
    out = out.orderBy(F.desc("count"), by_name("name"), "name")
    return out.limit(limit) if limit else out


def latest_per_key(rows: DataFrame, key: str = "target_key", institution: str = "institution", date: str = "date", order: Sequence[str] = SEQ) -> DataFrame:
    """The latest row of each key and institution, ties to the later one, with the key's first place in the input."""
    held = [c for c in rows.columns if c not in (key, institution)]
    when = F.struct(date, *order)
    out = rows.groupBy(key, institution).agg(F.max_by(F.struct(*held), when).alias("_l"), F.min(F.struct(*order)).alias("first_seq"))
    return out.select(key, institution, "_l.*", "first_seq")


def institution_matrix(
    rows: DataFrame, key: str = "target_key", name: str = "target_name", institution: str = "institution", date: str = "date",
    rating: str = "rating", price: str = "target_price", order: Sequence[str] = SEQ,
) -> DataFrame:
    """Latest views by target name, with the name's item count, first place and whether views differ."""
    latest = latest_per_key(rows, key, institution, date, order)
    grouped = latest.groupBy(name).agg(
        F.count("*").alias("n_items"), F.min("first_seq").alias("row_seq"),
        F.countDistinct(F.nullif(F.col(rating).cast("string"), F.lit(""))).alias("n_ratings"),
        F.countDistinct(F.nullif(F.col(price).cast("string"), F.lit(""))).alias("n_prices"),
    )
    out = latest.join(grouped, name)
    return out.withColumn("diverges", (F.col("n_items") > 1) & ((F.col("n_ratings") > 1) | (F.col("n_prices") > 1)))


def matrix_order(institution: str = "institution") -> list[Column]:
    return [F.desc("n_items"), F.asc("row_seq"), F.asc(institution), F.asc("first_seq")]


def diverging_names(matrix: DataFrame, name: str = "target_name", limit: int = 30) -> DataFrame:
    rows = matrix.where("diverges").groupBy(name).agg(F.first("n_items").alias("n_items"), F.first("n_ratings").alias("n_ratings"), F.first("n_prices").alias("n_prices"), F.first("row_seq").alias("row_seq"))
    return rows.orderBy(F.desc("n_items"), "row_seq").limit(limit)


def trailing_consensus(rows: DataFrame, day: Column, key: str = "target_key", institution: str = "institution", price: str = "target_price", days: int = 90) -> DataFrame:
    """``rows`` with what was said of their key within the ``days`` before, their own day included.

    A RANGE frame on the day, so gaps count as time and all rows of a day see each
    other: how many views, their least, greatest and summed prices, and how many
    institutions.  ``revisions`` is the number of views by the row's institution
    in that time whose price differs from the view before.
    """
    number = F.unix_date(day)
    by_key = Window.partitionBy(key).orderBy("_day").rangeBetween(-days, 0)
    by_view = Window.partitionBy(key, institution).orderBy("_day").rangeBetween(-days, 0)
    in_turn = Window.partitionBy(key, institution).orderBy("_day", price)
    out = rows.withColumn("_day", number).withColumn("_other", (F.lag(price).over(in_turn) != F.col(price)).cast("bigint"))
    return out.withColumns({
        "views": F.count(price).over(by_key), "least": F.min(price).over(by_key), "greatest": F.max(price).over(by_key), "total": F.sum(price).over(by_key),
        "voices": F.size(F.collect_set(institution).over(by_key)).cast("bigint"), "revisions": F.coalesce(F.sum("_other").over(by_view), F.lit(0)),
    }).drop("_day", "_other")


def diff_snapshots(before: DataFrame, after: DataFrame, key: str, payload: str, order: str | None = None) -> DataFrame:
    """(key, change_type, previous and next payload) of rows added, modified or removed.

    Every row of ``after`` meets the last row of its key in ``before``; every row
    of ``before`` without its key in ``after`` is removed.
    """
    order = order or payload
    last = before.groupBy(key).agg(F.max_by(payload, order).alias("previous"))
    met = after.select(key, F.col(payload).alias("next")).join(last.withColumn("_held", F.lit(True)), key, "left")
    kind = F.when(F.col("_held").isNull(), "added").when(~F.col("previous").eqNullSafe(F.col("next")), "modified")
    changed = met.withColumn("change_type", kind).where("change_type is not null").select(key, "change_type", "previous", "next")
    gone = before.join(after.select(key), key, "left_anti")
    return changed.unionByName(gone.select(key, F.lit("removed").alias("change_type"), F.col(payload).alias("previous"), F.lit(None).cast(before.schema[payload].dataType).alias("next")))


def match_watchlist(rows: DataFrame, fields: Column, watch: DataFrame, key: Sequence[str], few: int = 16, most_chars: int = 20_000_000) -> DataFrame:
    """Rows met with every watch item one of whose ``norm_aliases`` is part of a field.

    A few items are tested one by one.  Longer lists are compiled into one
    automaton that reads each field once, whatever the number of aliases; it is
    sent to the executors, so the aliases' characters are counted first.  Beyond,
    aliases and fields meet on the alias's whole text: a field offers each of its
    substrings of a length that some alias has.  An empty alias matches every row
    with a field.  ``key`` identifies rows.
    """
    said = F.transform("norm_aliases", lambda a: F.length(a).cast("bigint"))
    items, chars = watch.agg(F.count("*"), F.coalesce(F.sum(F.aggregate(said, F.lit(0).cast("bigint"), lambda n, x: n + x)), F.lit(0))).first()
    if items <= few:
        met = F.exists("norm_aliases", lambda a: F.exists(fields, lambda f: F.contains(f, a)))
        return rows.join(F.broadcast(watch), met)
    asked = watch.select("watch_id", F.explode("norm_aliases").alias("_a"))
    if chars <= most_chars:
        found = many_patterns(rows.sparkSession, [(r["watch_id"], r["_a"]) for r in asked.where("_a is not null").toLocalIterator()])
        return rows.withColumn("watch_id", F.explode(found(fields))).join(watch, "watch_id")
    lengths = [r[0] for r in asked.select(F.length("_a")).distinct().collect()]
    sub = lambda f: F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(
        n <= F.length(f), F.transform(F.sequence(F.lit(1), F.length(f) - n + 1), lambda i: F.substring(f, i, n))).otherwise(F.array().cast("array<string>"))))
    offered = rows.select(*key, F.explode(F.array_distinct(F.flatten(F.transform(fields, sub)))).alias("_a"))
    met = offered.join(asked, "_a").select(*key, "watch_id").distinct()
    return rows.join(met, list(key)).join(watch, "watch_id")


def many_patterns(spark: SparkSession, patterns: list[tuple[str, str]]):
    """A function of an array of texts: the owners, each once and in order, of the patterns (owner, pattern) that some text holds."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for owner, pattern in patterns:
        owners.setdefault(pattern, set()).add(owner)
    everyone = owners.pop("", set())
    automaton = ahocorasick.Automaton()
    for pattern, own in owners.items():
        automaton.add_word(pattern, tuple(own))
    automaton.make_automaton()
    shared = spark.sparkContext.broadcast((automaton if owners else None, everyone))

    @F.pandas_udf(ArrayType(StringType()))
    def found(lists: pd.Series) -> pd.Series:
        machine, always = shared.value

        def of(texts) -> list[str]:
            met = set(always) if texts is not None and any(t is not None for t in texts) else set()
            for text in texts if texts is not None and machine else ():
                if text:
                    for _, own in machine.iter(text):
                        met.update(own)
            return sorted(met)

        return lists.map(of)

    return found


def watch_summary(met: DataFrame, watch: DataFrame, date: str, order: Sequence[str], show: Sequence[str]) -> DataFrame:
    """Per watch item, also unmatched ones: mention count and the latest mention, ties to the earliest place."""
    latest = met.groupBy("watch_id").agg(
        F.count("*").alias("mention_count"), F.max(date).alias("_d"),
    )
    best = met.join(latest, "watch_id").where(F.col(date) == F.col("_d")).groupBy("watch_id").agg(F.min_by(F.struct(date, *show), F.struct(*order)).alias("latest"))
    out = watch.select("watch_id", "name").join(latest.select("watch_id", "mention_count"), "watch_id", "left").join(best, "watch_id", "left")
    return out.select("watch_id", "name", F.coalesce("mention_count", F.lit(0)).cast("bigint").alias("mention_count"), F.col(f"latest.{date}").alias("latest_date"), *[F.col(f"latest.{c}").alias(f"latest_{c}") for c in show])


def with_bar_width(counts: DataFrame, most: float | None = None) -> DataFrame:
    """``counts`` with ``width``: percent of the largest count, or of ``most``, 100 at most.  The largest is one scalar, not a window."""
    largest = F.lit(float(most)) if most else counts.agg(F.max("count")).scalar()
    return counts.withColumn("width", F.least(F.lit(100.0), F.col("count") * 100 / largest))
