"""Kept counts and newest-first answers against scans of the tables."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import analytics as A
from marlstone.operators import search as S
from marlstone.plans import index as I
from marlstone.plans import kept as K

FILES = "file_path string, markdown string, updated_at timestamp"


def note(rng, k):
    blocks = []
    for _ in range(rng.randint(0, 3)):
        code = f"{rng.randint(1, 40):04d}.HK"
        blocks.append(f"# 所{rng.randint(0, 3)}\n榉木纸业{code[:4]} ({code})\n首予“{rng.choice(['买入', '卖出'])}”评级，目标价 {rng.randint(1, 9)}港元\n主要风险：运价\n#{rng.choice('甲乙丙')} #{rng.choice('甲丁')}\n")
    return f"序 {k}\n" + "\n".join(blocks)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(11)
    notes = [(f"/n/{2019 + k % 8}/{2019 + k % 8}-{1 + k % 12:02d}-{1 + k % 28:02d}.md", note(rng, k), None) for k in range(160)]
    notes += [(f"/n/{name}-{k}.md", note(rng, k), None) for k, name in enumerate(["19x", "zz", "榉", "2022"])]
    return I.build(spark, spark.createDataFrame(notes, FILES), "/n", str(tmp_path_factory.mktemp("kept")))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kept_counts_equal_scans(index):
    assert rows(index.themes(99)) == rows(A.count_by(index.blocks.select(F.explode("tags").alias("t")), F.col("t")))
    assert rows(K.top(index.counts, K.YEAR)) == rows(A.count_by(index.reports, F.col("year")))
    assert rows(K.top(index.counts, K.INSTITUTION, 2)) == rows(A.count_by(index.blocks, F.col("institution"), 2))
    both = index.institutions()
    assert rows(both["coverage"]) == rows(A.count_by(index.mentions, F.col("institution"))) and rows(both["target_coverage"]) == rows(A.count_by(index.mentions, F.col("target_name"), 30))
    status = index.status()
    assert (status["report_count"], status["mention_count"]) == (index.reports.count(), index.mentions.count())
    assert status["target_count"] == index.mentions.select("target_key").distinct().count() == index.target_count()
    assert status["latest_date"] == index.reports.where("part <> 'undated'").agg(F.max("date")).first()[0]
    asked = index.themes()
    assert all("/counts/" in f for f in asked.inputFiles())
    assert "kind#" in asked._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_a_version_without_counts_counts_now(spark, index):
    older = I.Index(spark, index.path)
    older._schemas = {k: v for k, v in index._schemas.items() if k not in ("counts", "sketches")}
    assert not older.keeps_counts and sorted(map(str, rows(older.counts.select("part", "kind", "name", "n")))) == sorted(map(str, rows(index.counts.select("part", "kind", "name", "n"))))
    assert older.target_count(exact=False) == index.target_count(exact=False)


def test_sketches_merge_within_their_error(spark, index):
    assert abs(index.target_count(exact=False) - index.target_count()) <= 1
    assert index.target_count(["2020", "2021"]) == index.mentions.where("part in ('2020', '2021')").select("target_key").distinct().count()
    part = F.concat(F.lit("20"), F.lpad((F.col("id") % 20).cast("string"), 2, "0"))
    names = spark.range(600_000).select(part.alias("part"), F.lit(K.KEY).alias("kind"), (F.col("id") % 200_003).cast("string").alias("name"), F.lit(1).alias("n"))
    told = K.about_distinct_targets(K.sketches(names))
    assert abs(told - 200_003) < 0.03 * 200_003
    some = K.about_distinct_targets(K.sketches(names), ["2003"])
    assert abs(some - 30_000) < 0.03 * 30_000
    assert K.about_distinct_targets(K.sketches(names), ["1999"]) == 0


@pytest.mark.parametrize("cap", [1, 7, 40, 10_000])
def test_newest_first_equals_the_whole(index, cap):
    newest = [F.desc("date"), F.desc("line_number"), F.asc("file_path"), F.asc("match_no")]
    for start, end in ((None, None), ("2020-05", "2024-03"), ("19", "2019-02-03")):
        whole = index.mentions.where(S.between_dates(F.col("date"), start, end)).where("rating = '买入'").orderBy(*newest).limit(cap)
        asked = index.newest(index.mentions, lambda df: df.where("rating = '买入'").orderBy(*newest).limit(cap), cap, start, end)
        assert rows(asked.select("date", "file_path", "line_number")) == rows(whole.select("date", "file_path", "line_number"))


def test_a_common_word_reads_the_newest_year_and_undated_notes(index, monkeypatch):
    read = []
    ask = S.search_lines
    monkeypatch.setattr(S, "search_lines", lambda lines, *a, **k: read.append({r[0] for r in lines.select("part").distinct().collect()}) or ask(lines, *a, **k))
    monkeypatch.setattr(S, "LIMIT", 10)
    monkeypatch.setattr(ask, "__defaults__", (None, 10, None))
    got = rows(index.search("序"))
    assert read == [{"2026", S.UNDATED}]
    assert got == rows(ask(index.lines, "序", None, 10)) and got[0][1] > "2027"
    read.clear()
    assert rows(index.search("序 3 榉")) == [] and read[-1] == {str(y) for y in range(2019, 2027)} | {S.UNDATED}


def test_refresh_keeps_the_counts_of_other_years(spark, tmp_path):
    root, out = tmp_path / "notes", str(tmp_path / "out")
    for day, tag in (("2025-01-01", "甲"), ("2026-01-01", "乙")):
        (root / day[:4]).mkdir(parents=True)
        (root / day[:4] / f"{day}.md").write_text(f"# 所\n榉木纸业 (0007.HK)\n买入评级\n#{tag}\n", encoding="utf-8")
    before = I.build_from_tree(spark, str(root), out)
    (root / "2026" / "2026-01-01.md").write_text("# 所\n榉木纸业 (0008.HK)\n买入评级\n#丙\n", encoding="utf-8")
    after = I.update(before, str(root), out)
    assert len(set(after.folders.values())) == 2 and sorted(rows(after.themes())) == [("丙", 1), ("甲", 1)]
    assert after.target_count() == after.target_count(exact=False) == 2 and before.target_count() == 1
