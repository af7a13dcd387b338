"""Blocks of Markdown as intervals of lines, and the block that shows a line.

``line_nodes`` is an interval join with a backward as-of fallback, done as one
sorted sweep of a note's starts, questions and ends; no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

# How lines of each kind begin.
FENCE = r"^ {0,3}(?:```|~~~)"
HEADING = r"^ {0,3}#{1,6}(?:[ \t]|$)"
RULE = r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$"
QUOTE = r"^ {0,3}>"
ITEM = r"^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|$)"


def markdown_nodes(lines: DataFrame) -> DataFrame:
    """The blocks of notes: (file_path, node, kind, start_line, end_line), numbered from 1 in order.

    Headings, rules and list items are one block each; a fence runs to the next
    fence line or the note's end; text runs to a blank line or another kind and
    goes on with the quote or item above it.  Blank lines belong to no block.
    """
    in_note = Window.partitionBy("file_path").orderBy("line_no")
    line, fence = F.col("line"), F.col("line").rlike(FENCE)
    inside = F.coalesce(F.sum(fence.cast("int")).over(in_note.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    kind = (
        F.when(F.col("inside") | fence, "code").when(trim(line) == "", F.lit(None).cast("string")).when(line.rlike(HEADING), "heading")
        .when(line.rlike(RULE), "rule").when(line.rlike(QUOTE), "quote").when(line.rlike(ITEM), "item").otherwise("text")
    )
    told = lines.select("file_path", "line_no", "line").withColumn("inside", inside).withColumn("kind", kind)
    above = F.lag("kind").over(in_note)
    goes_on = (
        F.when(F.col("kind") == "code", F.col("inside")).when(F.col("kind") == "quote", above == "quote")
        .when(F.col("kind") == "text", above.isin("text", "quote", "item")).otherwise(False)
    )
    told = told.withColumn("opens", F.col("kind").isNotNull() & ~F.coalesce(goes_on, F.lit(False)))
    told = told.withColumn("node", F.sum(F.col("opens").cast("int")).over(in_note)).where("kind is not null")
    return told.groupBy("file_path", "node").agg(F.min_by("kind", "line_no").alias("kind"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))


def line_nodes(asked: DataFrame, nodes: DataFrame, note: str = "file_path", line: str = "line_no", start: str = "start_line", end: str = "end_line", node: str = "node") -> DataFrame:
    """``asked`` with the ``node`` of its note that holds its line: the first by (start, node), else the one that starts last before it.

    Nodes may nest and overlap; of several that start last, the first counts.  A
    line that is null or before all nodes has none.  The first node that reaches a
    line reaches beyond all before it, so only such nodes' ends take part.
    """
    nodes = nodes.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    before = Window.partitionBy(note).orderBy(start, node).rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(F.col(start).alias("start"), F.col(node).alias("node"))
    held = nodes.select(F.col(note).alias("_note"), F.col(start).alias("_start"), F.col(end).alias("_end"), own.alias("_own"), F.coalesce(F.col(end) > F.max(end).over(before), F.lit(True)).alias("_reaches"))
    rows = asked.select(F.col(note).alias("_note"), F.col(line).alias("_at"), F.lit(1).alias("_turn"), F.struct(*asked.columns).alias("_asked"))
    for at, turn, some in (("_start", 0, held), ("_end", 2, held.where("_reaches"))):
        rows = rows.unionByName(some.select("_note", F.col(at).alias("_at"), F.lit(turn).alias("_turn"), "_own"), allowMissingColumns=True)
    sweep = Window.partitionBy("_note").orderBy("_at", "_turn", F.desc("_own.node"))
    below = F.last(F.when(F.col("_turn") == 0, F.col("_own")), ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    reaching = F.first(F.when(F.col("_turn") == 2, F.col("_own")), ignorenulls=True).over(sweep.rowsBetween(0, Window.unboundedFollowing))
    met = rows.withColumns({"_below": below, "_reaching": reaching}).where("_turn = 1")
    found = F.when(F.col("_at").isNull(), None).when(F.col("_reaching.start") <= F.col("_at"), F.col("_reaching.node")).otherwise(F.col("_below.node"))
    return met.select("_asked.*", found.alias(node))
