"""Notes to rows: reports, lines, institution blocks, target mentions, signals.

A note is keyed by its path; ids may collide.  ``seq`` columns carry the order
that the answers depend on: path, line, position on the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import report as R
from ..functions.text import SPACE, WS, compact, contains_any, nfkc, nfkc_all, normalize, normalize_all, tidy, trim, unique_by

CONTEXT_LINES = 8
NAME_LIMIT = 40
TITLE_LIMIT = 48


def report_id(path: Column, root: str) -> Column:
    """The path below the root; separators become ``__``, other runs ``_``."""
    base = root.rstrip("/") + "/"
    below = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    below = F.regexp_replace(below, r"(?i)\.md\z", "")
    return F.regexp_replace(F.regexp_replace(below, r"[/\\]+", "__"), r"[^A-Za-z0-9_.-]+", "_")


def report_date(path: Column, rid: Column) -> Column:
    """The first date in path and id, else the id."""
    source, pattern = F.concat_ws(" ", path, rid), r"(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
    part = lambda g: F.regexp_extract(source, pattern, g)
    dated = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", dated).otherwise(rid)


def build_reports(files: DataFrame, root: str = "") -> DataFrame:
    """``files`` (file_path, markdown, updated_at) to reports."""
    out = files.withColumn("report_id", report_id(F.col("file_path"), root))
    out = out.withColumn("date", report_date(F.col("file_path"), F.col("report_id")))
    return out.withColumns({
        "year": F.left("date", F.lit(4)),
        "title": F.element_at(F.split("file_path", "/", -1), -1),
        "line_count": F.size(F.split("markdown", r"\r?\n", -1)),
        "date_typed": F.try_to_date("date"),
    })


def heading(line: Column) -> Column:
    """The institution that a line opens a block for, null on other lines."""
    name = trim(F.regexp_extract(line, f"^#{SPACE}+([^#].*?){SPACE}*\\z", 1))
    return F.when(F.startswith(line, F.lit("#")) & (name != "") & (F.length(name) <= NAME_LIMIT), name)


def build_lines(reports: DataFrame) -> DataFrame:
    """One row per line, raw and in normal form, with its block.

    Blocks are cut from the array of a report's lines before lines become rows,
    so nothing is shuffled.
    """
    held = reports.select("file_path", "report_id", "date", F.split("markdown", r"\r?\n", -1).alias("ls"))
    heads = F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("at"), heading(x).alias("name"))), lambda h: h["name"].isNotNull())
    held = held.withColumn("heads", heads)
    until = lambda i: F.coalesce(F.get("heads", i)["at"] - 1, F.size("ls"))
    block = lambda first, start, end, name: F.struct(first.alias("first"), start.alias("block_start"), end.alias("block_end"), name.alias("institution"))
    blocks = F.concat(
        F.array(block(F.lit(1), F.lit(None).cast("int"), until(F.lit(0)), F.lit(None).cast("string"))),
        F.transform("heads", lambda h, i: block(h["at"], h["at"], until(i + 1), h["name"])),
    )
    lines = held.select("file_path", "report_id", "date", "ls", F.explode(blocks).alias("b"))
    lines = lines.select("file_path", "report_id", "date", "b", F.posexplode(F.slice("ls", F.col("b.first"), F.col("b.block_end") - F.col("b.first") + 1)).alias("p", "line"))
    return lines.select("file_path", "report_id", "date", (F.col("b.first") + F.col("p")).alias("line_no"), "line", normalize(F.col("line")).alias("norm_line"), "b.block_start", "b.block_end", "b.institution")


def with_nearby(rows: DataFrame, lines: DataFrame, radius: int, line_no: str = "line_no", name: str = "near", few: bool = False) -> DataFrame:
    """``rows`` with the compacted text of the lines around theirs, within the report.

    Only the neighbours of ``rows`` are fetched.  ``rows`` may name a line twice.  A
    ``few`` of them, which a limit bounds, are sent to the lines.
    """
    wanted = rows.select("file_path", F.col(line_no).alias("_at")).distinct()
    wanted = wanted.select("file_path", "_at", F.explode(F.sequence(F.col("_at") - radius, F.col("_at") + radius)).alias("_k"))
    text = lines.select(F.col("file_path").alias("_f"), F.col("line_no").alias("_l"), "line")
    met = (F.broadcast(wanted) if few else wanted).join(text, (F.col("file_path") == F.col("_f")) & (F.col("_k") == F.col("_l")))
    # at most 2 * radius + 1 lines
    around = met.groupBy("file_path", "_at").agg(F.array_sort(F.collect_list(F.struct("_k", "line"))).alias("_around"))
    around = around.select(F.col("file_path").alias("_f"), "_at", compact(F.array_join(F.transform("_around", lambda x: x["line"]), "\n")).alias(name))
    return rows.join(around, (F.col("file_path") == F.col("_f")) & (F.col(line_no) == F.col("_at"))).drop("_f", "_at")


def line_tags(line: Column) -> Column:
    tagged = F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("# "))
    return F.when(tagged, F.regexp_extract_all(line, F.lit(f"#([^{WS}#]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def build_blocks(lines: DataFrame) -> DataFrame:
    """One row per institution block: bounds, tags in first spelling, content."""
    inside = lines.where(F.col("block_start").isNotNull())
    grouped = inside.groupBy("file_path", "report_id", "date", "block_start").agg(
        F.first("institution").alias("institution"),
        F.max("line_no").alias("end_line"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"),
    )
    tags = F.filter(F.transform(F.flatten(F.transform("ls", lambda x: line_tags(x["line"]))), trim), lambda t: t != "")
    grouped = grouped.withColumn("raw_tags", tags)
    return grouped.withColumn("tag_keys", normalize_all(F.col("raw_tags"))).select(
        "file_path", "report_id", "date", F.col("block_start").alias("start_line"), "end_line", "institution",
        unique_by(F.col("raw_tags"), F.col("tag_keys")).alias("tags"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"),
    )


def target_candidates(lines: DataFrame) -> DataFrame:
    """Names with a parenthesis that head a target: name, code, aliases, line, position."""
    line = F.col("line")
    covered = contains_any(line, ["覆盖个股", "覆盖公司"])
    some = lines.where(F.col("block_start").isNotNull() & line.rlike("[（(]"))
    some = some.select("file_path", "report_id", "date", "institution", "block_start", "block_end", "line_no", covered.alias("covered"), line.rlike(R.MARKUP_PREFIX + R.NAMED_PAREN).alias("heads"), F.posexplode(F.regexp_extract_all(line, F.lit(R.NAMED_PAREN), F.lit(0))).alias("pos", "p"))
    raw = F.regexp_extract("p", "^[^（(]*", 0)
    inside = trim(F.substring("p", F.length(raw) + 2, F.length("p") - F.length(raw) - 2))
    some = some.withColumns({"name": R.clean_name(raw), "inside": inside, "code": F.nullif(F.regexp_extract(inside, R.LISTED_CODE, 0), F.lit(""))})
    some = some.where(F.col("covered") | (F.col("code").isNotNull() & F.col("heads") & (F.col("pos") == 0)))
    parts = F.filter(F.transform(F.split("inside", "[/,，;；]", -1), trim), lambda a: a != "")
    # not deterministic for the optimizer, which else cleans and composes names again for the filter
    composed = nfkc_all.asNondeterministic()(F.col("all_names"))
    some = some.withColumn("all_names", F.concat(F.array("name"), parts)).withColumn("composed", composed).withColumn("name_keys", F.transform("composed", tidy))
    some = some.withColumn("norm_name", F.get("name_keys", F.lit(0))).where(~R.is_noise(F.col("norm_name")))  # an empty one is noise
    return some.withColumns({
        "aliases": unique_by(F.col("all_names"), F.col("name_keys")),
        "norm_fields": F.array_distinct(F.filter(F.concat(F.array("norm_name", F.lower("code")), "name_keys"), lambda k: k.isNotNull() & (k != ""))),
        "idents": F.array_distinct(F.filter(F.concat(F.array(F.lower("code")), "name_keys"), lambda k: k.isNotNull() & (F.length(k) >= 2))),
    }).drop("p", "covered", "heads", "inside", "all_names", "composed", "name_keys")


def extract_mentions(lines: DataFrame) -> DataFrame:
    """The mentions of a corpus of lines, with the last line of each one's context (``end_line``).

    ``lines`` holds every line of its notes.  Windows of a block's candidates don't
    overlap, so one sorted sweep of the block deals each line to the candidate
    above it; no lines are joined.
    """
    found = target_candidates(lines)
    # A line is in the context if it is in the window, or later in the block and says
    # something about the candidate by name.
    none = lambda kind: F.lit(None).cast(kind)
    key, at = ["file_path", "block_start", "line_no", "pos"], F.col("line_no")
    own = F.struct("pos", "norm_name", F.coalesce("code", F.lit("")).alias("known"), "report_id", "date", "institution", "name", "aliases", "code", "block_end", "norm_fields")
    heads = found.select(*key, F.lit(0).alias("turn"), none("int").alias("at"), none("string").alias("line"), own.alias("own"))
    later = _named_later(found, lines).select(*key, F.lit(0).alias("turn"), "at", "line")
    inside = lines.where(F.col("block_start").isNotNull()).select("file_path", "block_start", "line_no", F.lit(1).alias("turn"), at.alias("at"), "line")
    rows = heads.unionByName(later, allowMissingColumns=True).unionByName(inside, allowMissingColumns=True)
    in_block = Window.partitionBy("file_path", "block_start").orderBy("line_no", "turn", "pos", "at")
    head = F.when(F.col("own").isNotNull(), at)
    rows = rows.withColumns({
        "above": F.last(head, ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, 0)),
        "lowest": F.max(head).over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    rows = rows.where((F.col("turn") == 0) | (F.col("above") < F.col("lowest")) | (at <= F.col("above") + CONTEXT_LINES))
    # of one line: its candidates, the lines of its window and what is said later
    told = rows.groupBy("file_path", "block_start", F.col("above").alias("line_no")).agg(
        F.array_sort(F.collect_list("own")).alias("all"), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "line", "pos"))).alias("said"),
        F.max(F.when(F.col("turn") == 1, at)).alias("until"), F.max("lowest").alias("lowest"),
    )
    again = lambda x, i: F.exists(F.slice("all", F.lit(1), i), lambda y: (y["norm_name"] == x["norm_name"]) & (y["known"] == x["known"]))
    once = F.explode(F.filter("all", lambda x, i: ~again(x, i)))
    told = told.select("file_path", "line_no", "said", "until", "lowest", F.element_at("all", -1)["pos"].alias("last_pos"), once.alias("own"))
    told = told.select("file_path", "line_no", "said", (F.col("own.pos") == F.col("last_pos")).alias("holds"), "until", "lowest", "own.*")
    end = F.when(~F.col("holds"), at - 1).when(at < F.col("lowest"), F.col("until")).otherwise(F.least("block_end", at + CONTEXT_LINES))
    told = told.withColumn("end_line", end)
    ours = F.filter("said", lambda x: (x["pos"].isNull() & F.col("holds")) | (x["pos"].eqNullSafe(F.col("pos")) & (x["at"] > F.col("end_line"))))
    told = told.withColumn("context", F.array_join(F.transform(F.array_sort(ours), lambda x: x["line"]), "\n")).drop("said").withColumn("nfkc_context", nfkc("context"))
    said = F.col("nfkc_context")
    told = told.withColumns({"rating": R.rating(said), "target_price": R.target_price(said), "current_price": R.current_price(said), "action": R.action(said), "excerpt": compact(F.col("context"))})
    told = told.withColumn("target_key", normalize(R.target_key(F.col("code"), F.col("name"), F.try_element_at("aliases", F.lit(1)))))
    return told.select(
        "report_id", "date", "institution", F.col("name").alias("target_name"), "aliases", "code", "rating", "target_price", "current_price", "action",
        F.col("line_no").alias("line_number"), "excerpt", "target_key", "file_path", F.col("pos").alias("match_no"), "norm_fields", "end_line",
    )


def _named_later(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines ``at`` of a block with a rating, price or action that name a candidate on or above them, by candidate.

    A block's names are one automaton that reads each line once, so names and lines are not paired.
    """
    key = ("file_path", "block_start", "line_no", "pos")
    names = found.where(F.size("idents") > 0).select(*key, F.array_join("idents", "\n").alias("said"), F.lit(None).cast("string").alias("line"))
    telling = lines.where(F.col("block_start").isNotNull() & R.may_tell(F.col("norm_line")))
    rows = names.unionByName(telling.select("file_path", "block_start", "line_no", F.col("norm_line").alias("said"), "line"), allowMissingColumns=True)
    # names, which have no line, come first
    dealt = rows.repartition("file_path", "block_start").sortWithinPartitions("file_path", "block_start", F.col("line").isNotNull())
    met = dealt.select(*key, "said", "line").mapInPandas(_names_said, "file_path string, block_start int, line_no int, pos int, at int, line string")
    met = met.withColumn("told", nfkc("line"))
    text = F.col("told")
    return met.where(R.may_tell(F.lower(text))).where(F.coalesce(R.rating(text), R.target_price(text), R.current_price(text), R.action(text)).isNotNull()).drop("told")


def _names_said(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows by block, names before lines: one row for each line and candidate named in it, but for lines above the candidate."""
    import ahocorasick

    block, owners, machine = None, {}, None
    for frame in frames:
        out = []
        for path, start, line_no, pos, said, line in frame.itertuples(index=False, name=None):
            if (path, start) != block:
                block, owners, machine = (path, start), {}, None
            if line is None:
                for name in said.split("\n"):
                    owners.setdefault(name, []).append((line_no, int(pos)))
            elif owners:
                if machine is None:
                    machine = ahocorasick.Automaton()
                    for name, own in owners.items():
                        machine.add_word(name, own)
                    machine.make_automaton()
                met = {own for _, named in machine.iter(said) for own in named if own[0] <= line_no}
                out.extend((path, start, *own, line_no, line) for own in sorted(met))
        yield pd.DataFrame(out, columns=["file_path", "block_start", "line_no", "pos", "at", "line"])


def extract_signals(mentions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per line of a mention's window that names a catalyst, a risk or another kind of signal.

    Windows don't overlap, so a line is in that of the last mention above it or in
    none: one sorted sweep of a note's lines and mentions finds it, and the lines around.
    """
    own = F.struct("report_id", "date", "institution", "target_name", F.col("line_number").alias("mention_line"), "match_no", "end_line")
    heads = mentions.select("file_path", F.col("line_number").alias("at"), F.lit(0).alias("turn"), "match_no", own.alias("own"))
    said = lines.select("file_path", F.col("line_no").alias("at"), F.lit(1).alias("turn"), "line", R.signal_type(F.col("norm_line")).alias("type"))
    in_note = Window.partitionBy("file_path").orderBy("at", "turn", "match_no")
    near = lambda side, by: F.expr(f"{side}(line, {by}) IGNORE NULLS OVER (PARTITION BY file_path ORDER BY at, turn, match_no)")
    rows = heads.unionByName(said, allowMissingColumns=True).withColumns({
        "own": F.last("own", ignorenulls=True).over(in_note.rowsBetween(Window.unboundedPreceding, 0)),
        "around": F.array(near("lag", 2), near("lag", 1), F.col("line"), near("lead", 1), near("lead", 2)),
    })
    rows = rows.where(F.col("type").isNotNull() & (F.col("own.end_line") >= F.col("at")))
    title = F.left(F.regexp_replace("line", f"^[-•{WS}]+", ""), F.lit(TITLE_LIMIT))
    excerpt = compact(F.array_join("around", "\n"))
    return rows.select("own.report_id", "own.date", "own.institution", "own.target_name", "type", title.alias("title"), excerpt.alias("excerpt"), F.col("at").alias("line_number"), "file_path", "own.mention_line", "own.match_no")
