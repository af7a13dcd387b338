"""Notes to answers on a small tree of files."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import report as R
from marlstone.functions import text as T
from marlstone.plans import index as I
from marlstone.plans import textindex
from marlstone.sources.config import Settings, UserConfig, split_aliases
from marlstone.sources.sync import refresh
from marlstone.streaming.ingest import stream_notes

#: One note for each thing that the questions below look at.
NOTES = {
    "2027/2027-03-01.md": "周一值班：赤松取消巡检\n# 甲所\n赤松电缆 (CSDL.KS)\n首予买入\n#电网\n",
    "2027/2027-03-02.md": "# 甲所\n赤松电缆 (CSDL.KS)\n评级：中性，目标价 31000元\n催化剂：海缆招标\n主要风险在铜价\n# 乙所\n赤松电缆 (CSDL.KS)\n下调至“减持”\n#电网 #铜 #电网\n",
    "2027/2027-03-03.md": "# 丙所\n覆盖个股：石榴影业（Garnet Film / GRNT.O）\n现价：7.5美元\n",
}
LAST = "03-03"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("notes"), tmp_path_factory.mktemp("index")
    for name, text in NOTES.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    I.build_from_tree(spark, str(root), str(out))
    return I.open_index(spark, str(out))


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_reports_and_blocks(index):
    assert [r["report_id"] for r in rows(index.list_reports())] == ["2027__2027-03-03", "2027__2027-03-02", "2027__2027-03-01"]
    assert index.list_reports(year="2027", institution="乙所").count() == 1 and index.list_reports(year="2026").count() == 0
    one = rows(index.summaries())
    assert {r["date"]: r["institutions"] for r in one} == {"2027-03-01": ["甲所"], "2027-03-02": ["甲所", "乙所"], "2027-03-03": ["丙所"]}
    assert {r["date"]: r["target_count"] for r in one} == {"2027-03-01": 1, "2027-03-02": 2, "2027-03-03": 1}
    assert {(r["institution"], tuple(r["tags"])) for r in rows(index.blocks)} == {("甲所", ("电网",)), ("甲所", ()), ("乙所", ("电网", "铜")), ("丙所", ())}
    held = index.report("2027__2027-03-02")
    assert held["report"].count() == 1 and held["blocks"].count() == 2 and held["mentions"].count() == 2


def test_lines_cover_every_line_once(index):
    got = rows(index.lines.where("date = '2027-03-01'").orderBy("line_no"))
    assert [r["line"] for r in got] == NOTES["2027/2027-03-01.md"].split("\n")
    assert [(r["block_start"], r["block_end"], r["institution"]) for r in got] == [(None, 1, None)] + [(2, 6, "甲所")] * 5


def test_years_and_dates_prune_partitions(index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (index.list_reports(year="2027"), index.search("x", start="2027-02", end="2028-01"), index.radar(start="2027-01-01")["first_coverages"]):
        assert any("part#" in p for p in plan(df).split("PartitionFilters: [")[1:] for p in [p.split("]")[0]])


def test_mentions(index):
    by = {(r["date"], r["institution"]): r for r in rows(index.mentions)}
    told = {k: (r["target_name"], r["code"], r["rating"], r["target_price"], r["current_price"], r["action"]) for k, r in by.items()}
    assert told == {
        ("2027-03-01", "甲所"): ("赤松电缆", "CSDL.KS", "买入", None, None, "首予"),
        ("2027-03-02", "甲所"): ("赤松电缆", "CSDL.KS", "中性", "31000元", None, None),
        ("2027-03-02", "乙所"): ("赤松电缆", "CSDL.KS", "减持", None, None, "下调"),
        ("2027-03-03", "丙所"): ("石榴影业", "GRNT.O", None, None, "7.5美元", None),
    }
    assert by["2027-03-03", "丙所"]["aliases"] == ["石榴影业", "Garnet Film", "GRNT.O"] and by["2027-03-03", "丙所"]["target_key"] == "grnt.o"
    assert {(r["type"], r["title"]) for r in rows(index.signals)} == {("catalyst", "催化剂：海缆招标"), ("risk", "主要风险在铜价")}
    assert rows(index.signals.where("type = 'risk'"))[0]["excerpt"] == "评级：中性，目标价 31000元 催化剂：海缆招标 主要风险在铜价 # 乙所 赤松电缆 (CSDL.KS)"


def test_search(index):
    assert index.search("garnet").count() == index.search("GARNET").count() == 1
    assert rows(index.search("值班"))[0]["institution"] == R.UNKNOWN_INSTITUTION and rows(index.search("值班"))[0]["snippet"] == "周一值班：赤松取消巡检 # 甲所"
    assert index.search("没有").count() == 0 and index.search(" ").count() == 0
    assert {r["date"] for r in rows(index.search("赤松", mode="rating"))} == {"2027-03-01", "2027-03-02"}
    assert [r["date"] for r in rows(index.search("中性评级"))] == ["2027-03-02"]
    assert index.search("", mode="rating").count() == 3 and index.search("评级", mode="rating", institution="乙所").count() == 2
    assert index.search("underweight", start="2027-03-02").count() == 1 and index.search("underweight", end="2027-03-01").count() == 0


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: "\n".join("".join(rng.choice("ab é东🙂") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9)))
    notes = [(f"/n/{2025 + k % 3}/{2025 + k % 3}-01-{1 + k % 28:02d}-{k}.md", f"# 所{k % 4}\n{text()}", None) for k in range(60)]
    plain = I.build(spark, spark.createDataFrame(notes, "file_path string, markdown string, updated_at timestamp"), "/n", str(tmp_path))
    indexed = None
    asked = ["ab", "a b", "é东", "🙂a", "aaa", "abab", "# 所", "没有", "b", "ba é"]
    want = {q: rows(plain.search(q)) for q in asked}
    indexed = plain.with_text_index()
    assert {q: rows(indexed.search(q)) for q in asked} == want and sum(map(len, want.values())) > 40
    assert rows(indexed.search("ab", start="2026-01-05", institution="所1")) == rows(plain.search("ab", start="2026-01-05", institution="所1"))
    files = {r["file_path"] for r in rows(plain.lines.where("contains(norm_line, 'aaa')"))}
    met = textindex.candidates(spark, f"{plain.path}/text-index", "aaa")
    assert {r["file_path"] for r in rows(met)} >= files
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan or "EqualTo(gram" in plan


def test_tables_without_rows_open(spark, tmp_path):
    schema = "file_path string, markdown string, updated_at timestamp"
    kinds = {"mention": "# 甲所\n只有一句话\n", "signal": "# 甲所\n赤松电缆 (CSDL.KS)\n买入评级\n", "heading": "没有机构\n", "empty": None}
    for kind, text in kinds.items():
        notes = [(f"/n/2027/2027-04-{k + 1:02d}.md", text, None) for k in range(3)] if text else []
        index = I.build(spark, spark.createDataFrame(notes, schema), "/n", str(tmp_path / kind))
        summary = I.open_index(spark, str(tmp_path / kind)).summary()
        assert summary["report_count"] == len(notes) and summary["mention_count"] == (3 if kind == "signal" else 0)
        assert index.profile("csdl")["mentions"].count() == summary["mention_count"] and index.radar()["risks"].count() == 0
        assert index.search("赤松").count() == summary["mention_count"] and index.export("summary").startswith("{")


def test_undated_notes_share_a_part(spark, tmp_path):
    notes = [(f"/n/{''.join(random.Random(k).choices('qwxz', k=5))}-{k}.md", "# 甲所\n赤松电缆 (CSDL.KS)\n买入评级\n", None) for k in range(300)] + [("/n/2027/2027-04-01.md", "# 乙所\n", None)]
    index = I.build(spark, spark.createDataFrame(notes, "file_path string, markdown string, updated_at timestamp"), "/n", str(tmp_path))
    assert {r["part"] for r in rows(index.reports.select("part").distinct())} == {"undated", "2027"}
    dates = [r["date"] for r in rows(index.reports)]
    assert index.search("买入评级", start="w", end="x").count() == sum("w" <= d <= "x" for d in dates) > 10
    year = next(d for d in dates if d[0] == "q")[:4]
    assert index.list_reports(year=year).count() == sum(d[:4] == year for d in dates)


def test_changes_matrix_profile(index):
    profile = index.profile("csdl.ks")
    changes = [(c["date"], c["institution"], c["change_type"], c["previous_rating"], c["current_rating"]) for c in rows(profile["rating_changes"])]
    assert sorted(changes) == [("2027-03-01", "甲所", "首予", None, "买入"), ("2027-03-02", "乙所", "下调", None, "减持"), ("2027-03-02", "甲所", "目标价变化", "买入", "中性")]
    summary = rows(profile["summary"])[0]
    assert (summary["first_mention"], summary["latest_mention"], summary["latest_rating"]) == ("2027-03-01", "2027-03-02", "减持")
    assert rows(profile["canonical_name"])[0]["canonical_name"] == "赤松电缆"
    view = index.institutions("赤松")
    assert sorted(r["institution"] for r in rows(view["matrix"])) == ["乙所", "甲所"]
    assert rows(view["divergence"])[0]["n_ratings"] == 2
    assert rows(index.institutions()["coverage"])[0] == {"name": "甲所", "count": 2}


def test_radar_and_summary(index):
    radar = index.radar()
    assert [(r["date"], r["change_type"]) for r in rows(radar["target_price_changes"])] == [("2027-03-02", "目标价变化")]
    assert rows(radar["themes"]) == [{"name": "电网", "count": 2}, {"name": "铜", "count": 1}]
    assert all(r["date"] >= "2027-03-02" for r in rows(index.radar(start="2027-03-02")["rating_changes"]))
    summary = index.summary()
    assert summary["report_count"] == 3 and summary["target_count"] == 2 and summary["error_count"] == 0 and summary["indexed_at"] is not None
    assert summary["latest_date"] == "2027-03-03" and summary["source_dir"].endswith("notes0")
    told = json.loads(index.export("summary"))
    assert told["latestDate"] == "2027-03-03" and told["reportCount"] == 3 and told["radar"]["targetPriceChanges"][0]["changeType"] == "目标价变化"
    assert index.export("target", "csdl").splitlines()[0] == "reportId,date,institution,targetName,aliases,code,rating,targetPrice,currentPrice,action,lineNumber,excerpt"
    assert index.export("search", "没有") == ""


def test_unknown_targets_answer_with_what_was_asked(index, tmp_path):
    config = UserConfig.load(tmp_path / "config.json").add_alias("无此", ["无彼"])
    profile = index.profile("无彼", config)
    assert rows(profile["canonical_name"]) == [{"canonical_name": "无彼"}] and [r["alias"] for r in rows(profile["aliases"])] == ["无此", "无此", "无彼"]
    assert profile["mentions"].count() == 0 and rows(profile["summary"])[0]["first_mention"] is None


def test_watchlist_and_config(index, tmp_path):
    path = tmp_path / "config.json"
    path.write_text("{broken", encoding="utf-8")
    config = UserConfig.load(path).add_watch("赤松", ["csdl.ks", " "]).add_watch("无此")
    config.add_watch("赤松", ["赤松电缆"], "n").add_alias("石榴", ["Garnet"])
    config = UserConfig.load(path)
    assert config.watchlist[0]["aliases"] == ["赤松", "csdl.ks", "赤松电缆"] and config.expand("garnet ") == ["石榴", "石榴", "Garnet"]
    view = index.watchlist(config)
    got = {r["name"]: (r["mention_count"], r["latest_date"]) for r in rows(view["watchlist"])}
    assert got == {"赤松": (3, "2027-03-02"), "无此": (0, None)}
    assert view["latest_changes"].count() == 3
    assert config.remove_watch(config.watchlist[0]["id"]).watchlist[0]["name"] == "无此"
    assert split_aliases("a, b，c d") == ["a", "b", "c", "d"]


def test_diff_and_errors(spark, index, tmp_path):
    files = {"2027/2027-03-02.md": NOTES["2027/2027-03-02.md"], "2027/2027-03-03.md": "# 改\n", "2027/2027-03-04.md": "# 新\n", "2027/2027-03-05.md": None}
    made = spark.createDataFrame([(f"/r/{p}", t, None) for p, t in files.items()], "file_path string, markdown string, updated_at timestamp")
    after = I.build(spark, made, "/r", str(tmp_path))
    assert [(r["change_type"], r["report_id"]) for r in rows(after.diff(index))] == [("added", "2027__2027-03-04"), ("modified", "2027__2027-03-03"), ("removed", "2027__2027-03-01")]
    status = after.status()
    assert status["report_count"] == 3 and status["error_count"] == 1 and rows(status["errors"])[0]["file_path"] == "/r/2027/2027-03-05.md"


def _written(root, notes):
    for name, text in notes.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def test_refresh_pulls_builds_and_compares(spark, tmp_path):
    root, out = tmp_path / "notes", str(tmp_path / "index")
    _written(root, {k: v for k, v in NOTES.items() if LAST not in k})
    assert I.open_index(spark, out, str(root)).status()["report_count"] == 2  # built on first use

    def runner(args, cwd, timeout):
        _written(root, {k: v for k, v in NOTES.items() if LAST in k})
        return "Updating 1..2", ""

    done = I.refresh(spark, str(root), out, runner)
    assert done["sync"].success and done["status"]["report_count"] == 3 and done["status"]["last_changes"] == 1
    assert [r["change_type"] for r in rows(done["changes"])] == ["added"] and I.open_index(spark, out).path == done["index"].path

    def failing(args, cwd, timeout):
        raise RuntimeError("no route")

    again = I.refresh(spark, str(root), out, failing)
    assert not again["sync"].success and again["changes"] is None and again["index"].path == done["index"].path


def test_update_parses_only_changed_years_and_equals_a_build(spark, tmp_path):
    root, out = tmp_path / "notes", str(tmp_path / "index")
    note = lambda k: f"# 所{k % 3}\n赤松电缆 (CSDL.KS)\n目标价 {k}00元\n风险：{k}\n#铜\n"
    _written(root, {f"{2024 + k % 4}/{2024 + k % 4}-05-{k + 1:02d}.md": note(k) for k in range(12)} | {"随笔.md": note(3)})
    first = I.build_from_tree(spark, str(root), out)
    assert I.update(first, str(root), out).path == first.path  # nothing to do

    _written(root, {"2025/2025-05-02.md": note(70), "2029/2029-01-01.md": note(71)})
    os.remove(root / "2026/2026-05-03.md")
    second = I.update(first, str(root), out)
    written = {p.name for p in (tmp_path / "index" / second.path.rsplit("/", 1)[1] / "reports").iterdir() if "=" in p.name}
    assert written == {"part=2025", "part=2026", "part=2029"} and set(second.folders) == {"2024", "2025", "2026", "2027", "2029", "undated"}
    whole = I.build_from_tree(spark, str(root), str(tmp_path / "whole"))
    for name in I.TABLES:
        assert sorted(map(str, getattr(second, name).drop("part").collect())) == sorted(map(str, getattr(whole, name).drop("part").collect())), name
    assert [(r["change_type"], r["report_id"]) for r in rows(second.diff(first))] == [("added", "2029__2029-01-01"), ("modified", "2025__2025-05-02"), ("removed", "2026__2026-05-03")]
    assert I.open_index(spark, out).path == second.path and rows(second.radar()["risks"]) == rows(whole.radar()["risks"])
    _written(root, {"2024/2024-05-01.md": note(72)})
    third = I.update(second, str(root), out)
    assert len(set(third.folders.values())) == 3 and third.mentions.count() == whole.mentions.count()


def test_a_file_that_cannot_be_read_is_an_error_and_links_are_left_out(spark, tmp_path):
    from marlstone.sources import markdown

    root = tmp_path / "notes"
    _written(root, {"2027/2027-04-01.md": "# 甲所\n", "2027/2027-04-02.md": "# 乙所\n"})
    os.symlink(root / "2027/2027-04-01.md", root / "2027/2027-04-03.md")
    os.symlink(root / "2027", root / "again")
    assert sorted(r["file_path"] for r in rows(markdown.read_markdown(spark, str(root)))) == [str(root / f"2027/2027-04-0{k}.md") for k in (1, 2)]
    frames = pd.DataFrame({"file_path": [str(root / "2027/2027-04-01.md"), str(root / "2027/gone.md")], "updated_at": [pd.NaT, pd.NaT]})
    (got,) = markdown._reader(str(root))(iter([frames]))
    assert got["content"].tolist() == ["# 甲所\n".encode(), None] and got["error"].tolist() == [None, "FileNotFoundError: No such file or directory"]
    files = spark.createDataFrame([(str(root / "2027/gone.md"), None, None, got["error"][1])], "file_path string, markdown string, updated_at timestamp, error string")
    assert rows(markdown.read_errors(files)) == [{"file_path": str(root / "2027/gone.md"), "message": "FileNotFoundError: No such file or directory"}]


def test_streamed_notes_open_as_an_index(spark, index, tmp_path):
    root, out = tmp_path / "notes", str(tmp_path / "index")
    _written(root, {k: v for k, v in NOTES.items() if LAST not in k})
    stream_notes(spark, str(root), out, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert I.open_index(spark, out).mentions.count() == 3
    _written(root, {k: v for k, v in NOTES.items() if LAST in k})
    stream_notes(spark, str(root), out, str(tmp_path / "checkpoint")).awaitTermination(120)
    streamed = I.open_index(spark, out)
    columns = ("date", "institution", "code", "rating", "target_price", "action")
    assert sorted(map(tuple, streamed.mentions.select(*columns).collect()), key=str) == sorted(map(tuple, index.mentions.select(*columns).collect()), key=str)
    assert sorted(r["change_type"] for r in rows(streamed.profile("csdl.ks")["rating_changes"])) == ["下调", "目标价变化", "首予"]
    assert streamed.search("赤松").count() == index.search("赤松").count() and streamed.status()["error_count"] == 0


def test_text_traps(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]

    assert one(T.normalize, "  ２５７７．ＨＫ　“Ａ”  b ") == '2577.hk "a" b' == T.normalize_literal("  ２５７７．ＨＫ　“Ａ”  b ")
    assert one(lambda c: F.regexp_extract(c, R.LISTED_CODE, 0), "前601989.SS") == "601989.SS"
    assert one(R.target_price, "目标价1,234港元") is None
    assert one(R.rating, "评级：说明。维持买入") == "买入"
    assert one(R.current_price, "现价 12.5 港元，区间 10-20") == "20"
    assert one(R.clean_name, "报告 - 我们对该公司") == "该"
    assert one(R.clean_name, "赤松是一家") == "赤松"
    assert one(T.compact, " a \r\n\n　b ") == "a b"
    assert R.parse_rating_query("growth") == "增持" and R.parse_rating_query("", "rating") == "*" and R.parse_rating_query("x") is None
    from marlstone.functions import markup as M

    assert one(M.protect_rules, "a\n==\n  ===  \n= =") == "a\n\\==\n  \\===  \n= ="
    assert [tuple(s) for s in one(M.highlight_segments, "a==b==c==d")] == [("a", False), ("b", True), ("c==d", False)]
    assert one(lambda c: M.highlight_terms(c, ["ab", "abc", "x"]), "ABCab") == "[[ABC]][[ab]]"
    assert one(lambda c: M.report_link(c, F.lit(3.7), F.array(F.lit("买 入"), F.lit(" "), F.lit("买 入"))), "a b") == "/reports?id=a+b&line=3&highlight=%E4%B9%B0+%E5%85%A5"


def test_names_are_ordered_as_people_do(spark):
    from marlstone.operators import analytics as A

    names = spark.createDataFrame([(n,) for n in ("b", "Zeta", "B", "Ä", "a", "华", "东", "", None)], "n string")
    assert [r["name"] for r in A.count_by(names, F.col("n"), 5).collect()] == ["a", "Ä", "b", "B", "Zeta"]
    counts = spark.createDataFrame([("a", 8), ("b", 2)], "name string, count long")
    assert [r["width"] for r in A.with_bar_width(counts).collect()] == [100.0, 25.0]
    assert [r["width"] for r in A.with_bar_width(counts, 100 / 6).collect()] == [48.0, 12.0]


def test_caps_of_the_answers(spark, tmp_path):
    notes = [(f"/n/2024/2024-{1 + k % 12:02d}-{1 + k % 28:02d}-{k}.md", f"# 机构{k % 25}\n目标{k} ({1000 + k}.HK)\n首次覆盖，买入评级，目标价 {k + 1} 港元\n催化剂：甲\n风险：乙\n#题{k % 40}\n", None) for k in range(120)]
    index = I.build(spark, spark.createDataFrame(notes, "file_path string, markdown string, updated_at timestamp"), "/n", str(tmp_path))
    radar, summary = index.radar(), index.summary()
    assert {k: v.count() for k, v in radar.items()} == {"first_coverages": 24, "rating_changes": 24, "target_price_changes": 0, "catalysts": 24, "risks": 24, "themes": 24}
    assert radar["risks"].count() == 24 and index.radar(limit=500)["first_coverages"].count() == 60 and index.radar(limit=500)["rating_changes"].count() == 60
    assert index.radar(limit=500)["catalysts"].count() + index.radar(limit=500)["risks"].count() == 80 and index.themes().count() == 30
    assert summary["latest_reports"].count() == 8 and summary["institutions"].count() == 18 and summary["radar"]["risks"].count() == 6
    assert index.institutions()["target_coverage"].count() == 30
    assert I.PROFILE_SIGNALS == 40 and index.profile("hk")["signals"].count() == 40 and index.profile("hk")["mentions"].count() == 120


def test_settings_and_sync():
    assert Settings.from_env({"REPORT_DIR": " ", "REPORTS_DIR": "/x", "PORT": "80a"}) == Settings("/x", ".", 80)
    assert Settings.from_env({"PORT": "-1"}).port == 3003
    heads = {"pull": RuntimeError("cannot open .git/FETCH_HEAD: Operation not permitted"), "--abbrev-ref": "main", "rev-parse": "abc", "ls-remote": "abc\trefs"}

    def runner(args, cwd, timeout):
        out = next(v for k, v in heads.items() if k in args)
        if isinstance(out, Exception):
            raise out
        return out, ""

    assert refresh("/d", runner).success
    heads["ls-remote"] = "def\trefs"
    assert not refresh("/d", runner).success
    heads["pull"] = RuntimeError("Permission denied (publickey)")
    assert "凭据" in refresh("/d", runner).stderr
    heads["pull"] = "Already up to date."
    assert refresh("/d", runner).stdout == "Already up to date."
