"""Multi-party perspective rotation of dialogues.

Every participant (a distinct role other than ``system``) of a dialogue gives
one rendering in which that speaker is the assistant and all others are named
users; the mask covers what the assistant says, with its end marker.

A rendering is returned in parts, so no row or task holds an unbounded dialogue;
parts joined in order are the whole rendering, and mask offsets (code points, end
exclusive) count from the start of the whole rendering.  A part holds the turns
of ``PART_TURNS`` consecutive turn numbers.  Where a turn number (or the null
one) is full, with more than ``PART_TURNS`` rows, as when rows of many dialogues
have lost their conv_id, each turn number of its range has parts of its own, and
the full one has a part for each role and range of text hashes, with
``PART_TURNS`` rows or so, and of a row repeated more often one for each
``PART_TURNS`` repeats.

Turns are ordered by ``turn`` (null first), then role, then the text's hash (MD5,
hexadecimal), then text; in a full turn number a row that is repeated more often
than ``PART_TURNS`` comes last of its hash range.  Repeated turns are each
rendered.  A null role is a
participant named ``unknown``; a null text renders as empty.  Rows whose conv_id
is null form one dialogue.  The system turns belong to nobody and are rendered
under ``system``; a dialogue with only system turns has no participant and gives
no row.  Markers inside texts are escaped: backslash doubled, ``<|`` becomes
``<\\|``.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stage

PART_TURNS = 64
SYSTEM = "system"
END = "<|end|>\n"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, speaker, part): text, masks and the part's first offset."""
    said = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        _escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    # repeated rows travel as one, with their number, and come apart in bounded pieces
    said = said.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("rows")).withColumn("md5", F.md5("text"))
    # written first, so that Spark can split a dialogue with many rows
    said = stage(said, "chat-turns")
    full = said.groupBy("conv_id", "turn").agg(F.sum("rows").alias("n")).where(F.col("n") > PART_TURNS)
    ranges = stage(full.select(F.col("conv_id").alias("rc"), F.floor(F.col("turn") / PART_TURNS).alias("range")).distinct(), "chat-full-ranges")
    roles = said.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("texts"))
    full = stage(roles.alias("r").join(full.alias("f"), F.expr("r.conv_id <=> f.conv_id and r.turn <=> f.turn")).select(
        F.col("r.conv_id").alias("fc"), F.col("r.turn").alias("ft"), F.col("role").alias("fr"), F.ceil(F.col("texts") / PART_TURNS).alias("pieces"),
    ), "chat-full-turns")
    cut = said.join(full, F.col("conv_id").eqNullSafe(F.col("fc")) & F.col("turn").eqNullSafe(F.col("ft")) & (F.col("role") == F.col("fr")), "left")
    cut = cut.join(ranges, F.col("conv_id").eqNullSafe(F.col("rc")) & F.floor(F.col("turn") / PART_TURNS).eqNullSafe(F.col("range")), "left")
    # a part of its own: number and role of the turn, the hash's range, the text if repeated, and the repeats' range
    bucket = F.floor(F.conv(F.left("md5", F.lit(7)), 16, 10).cast("bigint") * F.col("pieces") / 2**28).cast("bigint")
    often = F.col("rows") > PART_TURNS
    nowhere = F.lit(-1).cast("bigint")
    none = F.lit("")
    block = lambda turn, role, bucket, md5, text: F.struct(
        F.coalesce(turn.cast("bigint"), F.lit(-(2**62))).alias("turn"), role.alias("role"), bucket.alias("bucket"), md5.alias("md5"), text.alias("text")
    )
    alone = block(F.col("turn"), F.col("role"), bucket, F.when(often, F.col("md5")).otherwise(none), F.when(often, F.col("text")).otherwise(none))
    first = F.when(F.col("rc").isNotNull() | F.col("range").isNotNull(), F.col("turn")).otherwise(F.floor(F.col("turn") / PART_TURNS) * PART_TURNS)
    joint = block(first, none, nowhere, none, none)
    pieces = cut.select("conv_id", "turn", "role", "text", "md5", F.when(F.col("pieces").isNull(), joint).otherwise(alone).alias("_block"), "rows",
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / PART_TURNS))).alias("_chunk"))
    times = F.least(F.col("rows") - F.col("_chunk") * PART_TURNS, F.lit(PART_TURNS)).cast("int")
    blocks = pieces.groupBy("conv_id", "_block", F.when(F.col("rows") > PART_TURNS, F.col("_chunk")).otherwise(0).alias("_chunk")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "md5", "text", times.alias("times")))), lambda t: F.array_repeat(F.struct(t["role"].alias("role"), t["text"].alias("text")), t["times"]))).alias("turns")
    )
    speakers = said.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    each = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def head(t: Column) -> Column:
        other = F.concat(F.lit("<|user name="), _escape(t["role"]), F.lit("|>\n"))
        return F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(other)

    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("masked"),
    ))
    each = each.select("conv_id", "speaker", "_block", "_chunk", F.size("turns").cast("bigint").alias("n_turns"), pieces.alias("_pieces"))
    each = each.withColumn("text", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"])), ""))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        return F.struct(
            end.alias("at"),
            F.when(p["masked"], F.array_append(acc["masks"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["masks"]).alias("masks"),
        )

    # A part's turns are bounded, so this array stays short.
    each = each.withColumn("_masks", F.aggregate("_pieces", start, step, lambda a: a["masks"])).drop("_pieces")
    # Only lengths run through the window; the parts themselves meet the sums again.
    each = stage(each, "chat-parts")
    order = Window.partitionBy("conv_id", "speaker").orderBy("_block", "_chunk")
    sums = each.select("conv_id", "speaker", "_block", "_chunk", F.length("text").cast("bigint").alias("n")).withColumns({
        "part": F.row_number().over(order).cast("bigint") - 1,
        "first_char": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero),
    }).drop("n")
    met = F.expr("e.conv_id <=> s.conv_id and e.speaker = s.speaker and e._block = s._block and e._chunk = s._chunk")
    each = each.alias("e").join(sums.alias("s"), met).select("e.*", "part", "first_char")
    masks = F.transform("_masks", lambda m: F.struct((m["start"] + F.col("first_char")).alias("start"), (m["end"] + F.col("first_char")).alias("end")))
    return each.select("conv_id", "speaker", "part", "n_turns", "first_char", "text", masks.alias("masks"))


def chat_digest(turns: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return rotate_perspectives(turns).select("conv_id", "speaker", "part", "n_turns", "first_char", "text", spans.alias("masks"))


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS text FROM conversations),
counted AS (
  SELECT *, md5(text) AS h, count(*) OVER (PARTITION BY conv_id, turn, role, text) AS same,
         row_number() OVER (PARTITION BY conv_id, turn, role, text) - 1 AS nth FROM (SELECT *, max(n) OVER (PARTITION BY conv_id, floor(turn / 64.0)) AS most FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM rows_))),
texts AS (SELECT conv_id, turn, role, count(DISTINCT text) AS texts FROM rows_ GROUP BY 1, 2, 3),
said AS (
  SELECT c.conv_id, c.role, text || '<|end|>' || chr(10) AS body,
         coalesce(CASE WHEN most > 64 THEN c.turn ELSE floor(c.turn / 64.0)::BIGINT * 64 END, -4611686018427387904) AS b1,
         CASE WHEN n > 64 THEN c.role ELSE '' END AS b2,
         CASE WHEN n > 64 THEN (('0x' || h[1:7])::BIGINT * ceil(texts / 64.0)::BIGINT) // 268435456 ELSE -1 END AS b3,
         CASE WHEN n > 64 AND same > 64 THEN h ELSE '' END AS b4, CASE WHEN n > 64 AND same > 64 THEN text ELSE '' END AS b5,
         CASE WHEN same > 64 THEN nth // 64 ELSE 0 END AS b6,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY b1, b2, b3, b4, b5, b6, c.turn NULLS FIRST, c.role, h, text) AS k
  FROM counted c JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.turn IS NOT DISTINCT FROM c.turn AND t.role = c.role),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
pieces AS (
  SELECT s.conv_id, speaker, b1, b2, b3, b4, b5, b6, k, body, role = speaker AS masked,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
              ELSE '<|user name=' || replace(replace(role, '\', '\\'), '<|', '<\|') || '|>' END || chr(10) AS head
  FROM said s JOIN speakers p ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
located AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS stop FROM pieces)
SELECT conv_id, speaker, dense_rank() OVER (PARTITION BY conv_id, speaker ORDER BY b1, b2, b3, b4, b5, b6) - 1 AS part,
       count(*) AS n_turns, min(stop - length(head) - length(body))::BIGINT AS first_char,
       string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (masked), '') AS masks
FROM located GROUP BY conv_id, speaker, b1, b2, b3, b4, b5, b6
"""
