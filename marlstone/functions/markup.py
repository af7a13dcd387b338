"""Markdown helpers: rule guard, highlights, links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim


def protect_rules(markdown: Column) -> Column:
    """Escapes the first ``=`` of lines made only of two or more, which would turn the line above into a heading."""
    return F.regexp_replace(markdown, r"(?m)^( {0,3})=(=+[ \t]*\r?)$", r"$1\\=$2")


def highlight_segments(text: Column) -> Column:
    """Array of (text, marked): ``==`` toggles through the whole text; an unpaired last one stays literal."""
    parts = F.split(text, "==", -1)
    odd = (F.size(parts) - 1) % 2 == 1
    last = F.size(parts)
    joined = F.concat(
        F.slice(parts, F.lit(1), F.greatest(last - 2, F.lit(0))),
        F.array(F.concat(F.try_element_at(parts, last - 1), F.lit("=="), F.element_at(parts, last))),
    )
    fixed = F.when(odd, joined).otherwise(parts)
    segments = F.transform(fixed, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked")))
    return F.filter(segments, lambda s: s["text"] != "")


def marker_count(text: Column) -> Column:
    return F.size(F.split(text, "==", -1)) - 1


def highlight_terms(text: Column, terms: list[str], before: str = "[[", after: str = "]]") -> Column:
    """Marks every leftmost longest occurrence of a term, whatever its case."""
    kept = sorted({t.strip() for t in terms if len(t.strip()) >= 2}, key=lambda t: (-len(t), t))
    if not kept:
        return text
    pattern = "(?iu)(" + "|".join(re.escape(t) for t in kept) + ")"
    return F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", before) + "$1" + re.sub(r"([\\$])", r"\\\1", after))


def report_link(report_id: Column, line: Column | None = None, terms: Column | None = None) -> Column:
    """``/reports?id=…&line=…&highlight=…``; lines from 1, terms trimmed, distinct, non-empty."""
    parts = [F.concat(F.lit("id="), F.url_encode(report_id))]
    if line is not None:
        whole = F.floor(line)
        parts.append(F.when(whole > 0, F.concat(F.lit("line="), whole.cast("string"))))
    if terms is not None:
        kept = F.array_distinct(F.filter(F.transform(terms, trim), lambda t: t != ""))
        parts.append(F.array_join(F.transform(kept, lambda t: F.concat(F.lit("highlight="), F.url_encode(t))), "&"))
    return F.concat(F.lit("/reports?"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "&"))


def mention_terms() -> Column:
    return F.array_distinct(F.filter(F.concat(F.array("target_name", "code"), "aliases"), lambda t: t.isNotNull() & (t != "")))


def signal_terms() -> Column:
    return F.array_distinct(F.filter(F.array("target_name", "title"), lambda t: t.isNotNull() & (t != "")))


def hit_terms(query: str) -> Column:
    return F.array_distinct(F.filter(F.array(F.col("matched_text"), F.lit(query)), lambda t: t.isNotNull() & (t != "")))
