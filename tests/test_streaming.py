"""Streams against the same questions on tables."""

import random

from pyspark.sql import functions as F

from marlstone.operators import analytics as A
from marlstone.streaming import changes as C
from marlstone.streaming import windows as W

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.repartition(4).write.parquet(str(tmp_path / "events"))
    table.where("event_id = 0").withColumn("ts", F.to_timestamp(F.lit("2999-01-01"))).write.mode("append").parquet(str(tmp_path / "events"))  # closes all windows before
    kinds = {"tumbling": lambda e: W.tumbling(e, "6 hours", by=("event_type",), late="40 days"), "sliding": lambda e: W.sliding(e, "2 hours", "1 hour", late="40 days"), "sessions": lambda e: W.sessions(e, "4 hours", by=("user_id",), late="40 days")}
    for name, ask in kinds.items():
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "events"))
        out, at = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-at")
        ask(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        got = sorted(map(tuple, spark.read.parquet(out).where("window_start < '2900-01-01'").collect()), key=str)
        assert got == sorted(map(tuple, ask(table).collect()), key=str) and len(got) > 20


def test_late_views_revise_changes(spark, tmp_path):
    rng = random.Random(6)
    schema = "target_key string, institution string, date string, file_path string, line_number int, match_no int, rating string, target_price string, action string, target_name string, report_id string"
    views = [(f"t{rng.randint(0, 3)}", f"i{rng.randint(0, 1)}", f"2027-01-{rng.randint(1, 28):02d}", f"/n/{k}", k % 5, 0, rng.choice(["买入", "持有", None]), rng.choice(["1港元", "2港元", None]), rng.choice([None, None, "", "维持"]), "n", "r") for k in range(60)]
    want = A.detect_changes(spark.createDataFrame(views, schema), keep=())
    columns = [c.split(" ")[0] for c in C.CHANGES.split(", ")][:-1]
    want = sorted(map(tuple, want.select(*columns).collect()), key=str)
    rng.shuffle(views)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for first in range(0, len(views), 15):  # later batches hold earlier dates
        spark.createDataFrame(views[first : first + 15], schema).coalesce(1).write.mode("append").parquet(source)
        stream = C.revised_changes(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    sent = spark.read.parquet(out)
    held = sent.groupBy(*columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    assert held.where("n <> 1").count() == 0 and sent.where("sign < 0").count() > 0
    assert sorted(map(tuple, held.select(*columns).collect()), key=str) == want
