"""A positional index of character pairs for exact searches of stored lines.

Every two neighbouring characters of a line in normal form are a gram.  The
postings of a gram in a note, (line, position) in order, are one row, in a note of
more lines than an Arrow batch a few; rows lie
in the note's ``part`` and in a bucket by the gram's hash, sorted by gram, so a
query reads the buckets of a few grams only.  How often each gram occurs is kept
beside them.

A query of two characters and more takes the rarest of its grams, and lines on
which all of them stand at the query's own distances are candidates; they are
then tested for the whole query.  Shorter queries have no gram and scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 2, 32
#: Grams of a query that are looked up, the rarest ones.
ASKED = 3
POSTINGS = "gram string, file_path string, at array<struct<line_no:int,pos:int>>, part string, bucket int"
COUNTS = "gram string, n bigint, bucket int"


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each batch of lines, a place as line * 2 ** 32 + position; a batch is grouped here, so rows are few."""
    for batch in batches:
        text = batch.column("norm_line").fill_null("").to_pylist()
        points = np.frombuffer("\n".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in text])[:-1])).astype(np.int64) if text else np.zeros(0, np.int64)
        note = batch.column("file_path").dictionary_encode()
        at = np.flatnonzero((points[:-1] != 10) & (points[1:] != 10)) if len(points) > 1 else np.zeros(0, np.int64)  # a line in normal form has no line break
        if not len(at):
            continue
        line = np.searchsorted(starts, at, "right") - 1
        gram, of = points[at] << 21 | points[at + 1], note.indices.to_numpy()[line].astype(np.int64)
        order = np.lexsort((gram, of))  # stable, so places stay in order
        gram, of, at, line = gram[order], of[order], at[order], line[order]
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))))
        place = batch.column("line_no").to_numpy()[line].astype(np.int64) << 32 | (at - starts[line] + 1)
        told = pa.array(line[first])
        yield pa.RecordBatch.from_arrays([
            batch.column("part").take(told), batch.column("file_path").take(told),
            pa.array([chr(g >> 21) + chr(g & 0x1FFFFF) for g in gram[first].tolist()], pa.string()),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), pa.array(place)),
        ], ["part", "file_path", "gram", "at"])


def write(lines: DataFrame, folder: str) -> None:
    """Index ``lines`` (file_path, line_no, norm_line, part) below ``folder``."""
    spark = lines.sparkSession
    postings = lines.select("part", "file_path", F.col("line_no").cast("int").alias("line_no"), "norm_line").mapInArrow(_postings, "part string, file_path string, gram string, at array<bigint>")
    postings = postings.withColumn("bucket", _bucket("gram")).repartition("part", "bucket", F.pmod(F.xxhash64("file_path"), F.lit(8))).sortWithinPartitions("part", "bucket", "gram", "file_path")
    place = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("line_no"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    postings = postings.withColumn("at", F.transform("at", place))
    postings.select("gram", "file_path", "at", "part", "bucket").write.partitionBy("part", "bucket").parquet(f"{folder}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    counts = stored.groupBy("gram").agg(F.sum(F.size("at")).alias("n")).withColumn("bucket", _bucket("gram"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/counts")


def rarest(spark: SparkSession, folder: str, text: str) -> dict[int, str] | None:
    """Offset and gram of the rarest grams of ``text``; None if one of its grams occurs nowhere."""
    grams = {i: text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    asked = sorted(set(grams.values()))
    literal = F.array(*map(F.lit, asked))
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.transform(literal, _bucket))).distinct().collect()]
    known = spark.read.schema(COUNTS).parquet(f"{folder}/counts").where(F.col("bucket").isin(buckets) & F.col("gram").isin(asked))
    times = {r["gram"]: r["n"] for r in known.select("gram", "n").collect()}  # at most the query's own grams
    if len(times) < len(asked):
        return None
    best = sorted(grams, key=lambda i: (times[grams[i]], i))
    chosen: dict[str, int] = {}
    for i in best:
        if len(chosen) < ASKED:
            chosen.setdefault(grams[i], i)
    return {i: g for g, i in chosen.items()}


def candidates(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """(part, file_path, line_no) of lines that may hold ``text``, which is in normal form and has a gram."""
    chosen = rarest(spark, folder, text)
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    if chosen is None:
        return postings.where(F.lit(False)).select("part", "file_path", F.lit(0).alias("line_no"))
    grams = sorted(chosen.values())
    buckets = sorted({r[0] for r in spark.range(1).select(F.explode(F.transform(F.array(*map(F.lit, grams)), _bucket))).collect()})
    offset = F.create_map(*[F.lit(x) for i, g in chosen.items() for x in (g, i)])
    met = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    met = met.select("part", "file_path", "gram", F.explode("at").alias("a")).select("part", "file_path", "a.line_no", (F.col("a.pos") - offset[F.col("gram")]).alias("start"))
    together = met.groupBy("part", "file_path", "line_no", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen))
    return together.select("part", "file_path", "line_no").distinct()
