"""Shared helpers: table access, staging in the shared folder, array prefix sums."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contract defines it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a folder of the machine serves a local session; a cluster
    could not reach it, so there an error is raised.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or f"{context._jvm.System.getProperty('java.io.tmpdir')}/marlstone-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, label: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what reads the result survives the loss of any executor
    and never recomputes ``df``.  Staged frames that nothing will read again,
    ``instead_of``, are deleted once it is written.  Spark drops the shuffle files
    of frames that nobody holds when the driver's heap is collected, so on a
    cluster that is asked for here: what made ``df`` leaves the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    discard(*instead_of)
    drop_finished(spark)
    return out


def drop_finished(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nobody holds; a local session has no executors' disks."""
    if not spark.sparkContext._jsc.sc().isLocal():
        gc.collect()
        spark._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged frames that nothing will read again."""
    for old in staged:
        spark = old.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(old.staged_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def derived(df: DataFrame, staged: DataFrame) -> DataFrame:
    """``df``, a plain view of a staged frame, deleted like it."""
    df.staged_at = staged.staged_at
    return df


def unused(names: Iterable[str], *stems: str) -> list[str]:
    """A column name for each stem that none of ``names`` equals, whatever the case."""
    held, out = {x.lower() for x in names}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "utf-8"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text falls in the fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of BIGINT.

    Two levels of about sqrt(n) elements keep the copying at n**1.5 where one
    growing array would take n**2.
    """
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def over(arr: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(arr))).cast("int")
        starts = F.sequence(F.lit(1), F.size(arr), width)

        def block(acc: Column, start: Column) -> Column:
            inner = F.aggregate(
                F.slice(arr, start, width),
                F.struct(acc["base"].alias("base"), empty.alias("out")),
                lambda a, v: F.struct((a["base"] + v).alias("base"), F.array_append(a["out"], a["base"] + v).alias("out")),
            )
            return bind(inner, lambda z: F.struct(z["base"].alias("base"), F.concat(acc["out"], z["out"]).alias("out")))

        return F.aggregate(starts, F.struct(zero.alias("base"), empty.alias("out")), block, lambda a: a["out"])

    return F.when(F.size(values) > 0, bind(values, over)).otherwise(empty)
