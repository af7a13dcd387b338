"""What keeps the index buildable when its notes grow: no pairs, no text carried along, nothing made that was not asked for."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import reports as P
from marlstone.plans import index as I
from marlstone.plans import textindex

SCHEMA = "file_path string, markdown string, updated_at timestamp"
NOTES = [
    ("/n/2031/2031-01-01.md", "# 甲所\n雪松 (0001.HK)\n平淡\n榆木 (0002.HK) 与 雪松 (0001.HK)\n" + "平淡\n" * 9 + "雪松评级：买入\n主要风险在雪松\n# 乙所\n雪松 (0001.HK)\n催化剂：招标\n", None),
    ("/n/2031/2031-01-02.md", "# 甲所\n榆木 (0002.HK)\n主要风险\n", None),
]


@pytest.fixture(scope="module")
def lines(spark):
    return P.build_lines(P.build_reports(spark.createDataFrame(NOTES, SCHEMA), "/n")).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mentions_and_signals_join_nothing(lines):
    mentions = P.extract_mentions(lines)
    assert "Join" not in plan(mentions) and "Join" not in plan(P.extract_signals(mentions, lines))
    got = {(r["date"][-2:], r["institution"], r["line_number"], r["target_name"]): (r["rating"], r["end_line"]) for r in mentions.collect()}
    assert got == {
        ("01", "甲所", 2, "雪松"): ("买入", 3), ("01", "甲所", 4, "榆木"): (None, 12),
        ("01", "乙所", 17, "雪松"): (None, 19), ("02", "甲所", 2, "榆木"): (None, 4),
    }
    told = {(r["date"][-2:], r["line_number"], r["target_name"], r["excerpt"]) for r in P.extract_signals(mentions, lines).collect()}
    assert told == {("01", 18, "雪松", "# 乙所 雪松 (0001.HK) 催化剂：招标"), ("02", 3, "榆木", "# 甲所 榆木 (0002.HK) 主要风险")}


def test_postings_are_grouped_in_the_batch():
    rows = pa.RecordBatch.from_pydict({"part": ["2031"] * 3, "file_path": ["a", "a", "b"], "line_no": pa.array([1, 2, 1], pa.int32()), "norm_line": ["ab🙂ab", "", "ab"]})
    (out,) = textindex._postings(iter([rows]))
    got = {(r["file_path"], r["gram"]): [(x >> 32, x & 0xFFFFFFFF) for x in r["at"]] for r in out.to_pylist()}
    assert got == {("a", "ab"): [(1, 1), (1, 4)], ("a", "b🙂"): [(1, 2)], ("a", "🙂a"): [(1, 3)], ("b", "ab"): [(1, 1)]} and out.num_rows == 4
    assert not list(textindex._postings(iter([rows.slice(1, 1)])))


def test_a_part_of_the_summary_makes_no_other(spark, tmp_path, monkeypatch):
    index = I.build(spark, spark.createDataFrame(NOTES, SCHEMA), "/n", str(tmp_path))
    whole = index.summary()
    assert whole["radar"]["risks"].count() == 1 and whole["report_count"] == 2 and len(whole) == 13
    want = [r.asDict() for r in index.list_reports().limit(8).collect()]
    for name in ("radar", "status", "list_reports"):
        monkeypatch.setattr(I.Index, name, lambda *a, **k: 1 / 0)
    summary = index.summary()
    assert {r["name"]: r["count"] for r in summary["institutions"].collect()} == {"甲所": 2, "乙所": 1}
    assert [r.asDict() for r in summary["latest_reports"].collect()] == want
    monkeypatch.undo()
    monkeypatch.setattr(I.A, "detect_changes", lambda *a, **k: 1 / 0)
    assert index.radar()["risks"].count() == 1


def test_rows_groups_of_long_notes_stay_small(spark, tmp_path):
    import pyarrow.parquet as pq

    long = spark.range(60).select(F.concat(F.lit("/n/2031/2031-01-01-"), F.col("id").cast("string"), F.lit(".md")).alias("file_path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60000)), lambda i: F.hex(F.xxhash64(i, "id"))), " ").alias("markdown"), F.lit(None).cast("timestamp").alias("updated_at")).coalesce(1)
    index = I.build(spark, long, "/n", str(tmp_path))
    sizes = [pq.ParquetFile(p).metadata.row_group(k).total_byte_size for p in map(str, (tmp_path / index.path.rsplit("/", 1)[1] / "reports").rglob("*.parquet")) for k in range(pq.ParquetFile(p).num_row_groups)]
    assert sum(sizes) > 50e6 and max(sizes) < 45e6
