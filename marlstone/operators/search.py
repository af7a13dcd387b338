"""Searches over lines and mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import report as R
from ..functions.text import SPACE, compact, nfkc, normalize_literal, tidy
from .reports import heading, with_nearby

LIMIT = 500
#: The part of notes without a date in path or name.
UNDATED = "undated"


def part_of(date: Column) -> Column:
    """The partition of a note in a stored table: its year, or one part for all notes without a date."""
    return F.when(date.rlike("^20[0-9]{2}-"), F.left(date, F.lit(4))).otherwise(F.lit(UNDATED))


def between_dates(date: Column, start: str | None, end: str | None) -> Column:
    """Inclusive and lexicographic; dates are text."""
    out = F.lit(True)
    if start:
        out = out & (date >= start)
    if end:
        out = out & (date <= end)
    return out


def in_period(start: str | None, end: str | None) -> Column:
    """``between_dates`` for a stored table: the partition column ``part`` is bounded too, and undated notes are looked at."""
    parts = between_dates(F.col("part"), start and start[:4], end and end[:4])
    return (parts | (F.col("part") == UNDATED)) & between_dates(F.col("date"), start, end)


def search_lines(lines: DataFrame, query: str | None, mode: str | None = None, limit: int = LIMIT, among: DataFrame | None = None) -> DataFrame:
    """Lines that contain the query in normal form, newest report first.

    The filter is a plain substring test on a stored column.  Neighbours are
    fetched for hits only; without a mode, which looks at the snippet, only for
    the hits within the limit.  ``among`` holds the lines from which neighbours
    come, if ``lines`` are but some of them.
    """
    text, newest = normalize_literal(query or ""), [F.desc("date"), F.asc("file_path"), F.asc("line_no")]
    hits = lines.where(F.contains("norm_line", F.lit(text))) if text else lines.where(F.lit(False))
    hits = hits.select("report_id", "date", F.coalesce("institution", F.lit(R.UNKNOWN_INSTITUTION)).alias("institution"), "line_no", "file_path")
    if mode not in R.SEARCH_MODES:
        hits = hits.orderBy(*newest).limit(limit)
    hits = with_nearby(hits, among or lines, 1, name="snippet", few=mode not in R.SEARCH_MODES)
    if mode in R.SEARCH_MODES:
        hits = hits.where(R.any_word(F.col("snippet"), R.SEARCH_MODES[mode]))
    hits = hits.orderBy(*newest).limit(limit)
    return hits.select("report_id", "date", "institution", F.col("line_no").alias("line_number"), "snippet", F.lit(query or "").alias("matched_text"))


def _rough(text: str) -> str:
    """A pattern that every composed line matches whose normal form holds ``text``, which is ASCII and in normal form."""
    same = {" ": f"{SPACE}+", "i": "[iIİ]", '"': '["“”]', "'": "['‘’]"}
    return "(?i)" + "".join(same.get(c) or re.escape(c) for c in text)


def search_notes(notes: DataFrame, query: str | None, limit: int = LIMIT, institution: Column | None = None) -> DataFrame:
    """``search_lines`` over notes (report_id, date, file_path, markdown) that are not stored as lines.

    A hit takes its neighbours and its institution from the array of its note's
    lines, so nothing is joined.  Whole notes are composed once and tested with a
    pattern; only lines that match it are brought to normal form.  ``institution``
    overrides what headings say.
    """
    text = normalize_literal(query or "")
    said = [institution.alias("said")] if institution is not None else []
    held = notes.where(F.lit(bool(text))).select("report_id", "date", "file_path", *said, "markdown", nfkc("markdown").alias("composed"))
    maybe = (lambda x: x.rlike(_rough(text))) if text.isascii() else lambda x: x.isNotNull()
    held = held.where(maybe(F.col("composed")))
    at = F.transform(F.split("composed", r"\r?\n", -1), lambda x, i: F.when(maybe(x) & F.contains(tidy(x), F.lit(text)), i + 1))
    held = held.select("report_id", "date", "file_path", *["said"] * len(said), F.split("markdown", r"\r?\n", -1).alias("ls"), F.filter(at, lambda i: i.isNotNull()).alias("at")).where(F.size("at") > 0)
    hits = held.select("*", F.explode("at").alias("line_no")).drop("at")
    if institution is None:
        above = F.filter(F.transform(F.slice("ls", F.lit(1), F.col("line_no")), heading), lambda h: h.isNotNull())
        hits = hits.withColumn("said", F.try_element_at(above, F.lit(-1)))
    near = F.slice("ls", F.greatest(F.col("line_no") - 1, F.lit(1)), F.when(F.col("line_no") > 1, 3).otherwise(2))
    hits = hits.select("report_id", "date", "file_path", "line_no", F.coalesce("said", F.lit(R.UNKNOWN_INSTITUTION)).alias("institution"), near.alias("near"))
    hits = hits.orderBy(F.desc("date"), F.asc("file_path"), F.asc("line_no")).limit(limit)
    return hits.select("report_id", "date", "institution", F.col("line_no").alias("line_number"), compact(F.array_join("near", "\n")).alias("snippet"), F.lit(query or "").alias("matched_text"))


def search_ratings(mentions: DataFrame, wanted: str, limit: int = LIMIT) -> DataFrame:
    """Mentions with the wanted rating (``*`` for any), newest first, then lower lines first."""
    price = F.when(F.col("target_price").isNotNull() & (F.col("target_price") != ""), F.concat(F.lit("｜目标价 "), "target_price")).otherwise("")
    hits = mentions.where(R.rating_matches(F.col("rating"), wanted)).orderBy(F.desc("date"), F.desc("line_number"), "file_path", "match_no").limit(limit)
    return hits.select(
        "report_id", "date", "institution", "line_number",
        F.concat("target_name", F.lit("｜"), "rating", price, F.lit("｜"), "excerpt").alias("snippet"),
        F.lit("评级" if wanted == "*" else f"{wanted}评级").alias("matched_text"),
    )


def mention_matches(norm_fields: Column, terms: list[str]) -> Column:
    """Any term is part of any normalised field."""
    def part_of(term: str) -> Column:
        return F.exists(norm_fields, lambda f: F.contains(f, F.lit(term)))

    out = F.lit(False)
    for term in terms:
        out = out | part_of(term)
    return out
