"""Where notes and questions behave in ways that a plain reading would miss."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import report as R
from marlstone.operators import analytics as A
from marlstone.operators import reports as P
from marlstone.operators import search as S
from marlstone.plans import index as I
from marlstone.sources.config import UserConfig
from marlstone.sources.export import csv_cell
from marlstone.sources.markdown import read_markdown


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def lines_of(spark, text, path="/n/2030/2030-01-02.md"):
    files = spark.createDataFrame([(path, text, None)], "file_path string, markdown string, updated_at timestamp")
    return P.build_lines(P.build_reports(files, "/n"))


def mentions_of(spark, text):
    return rows(P.extract_mentions(lines_of(spark, text)).orderBy("line_number", "match_no"))


def test_dates_and_ids_of_paths(spark):
    paths = ["/n/2031/04/2031-04-10.md", "/n/2031/2031-4-9.md", "/n/随笔/甲.md", "/n/随笔/乙.md", "/n/notes.MD"]
    got = {r["file_path"]: (r["report_id"], r["date"]) for r in rows(P.build_reports(spark.createDataFrame([(p, "", None) for p in paths], "file_path string, markdown string, updated_at timestamp"), "/n"))}
    # the first date over the whole path counts, also across folders; other runs collapse, so ids may collide
    assert got[paths[0]][1] == "2031-04-20" and got[paths[1]][1] == "2031-04-09"
    assert got[paths[2]][0] == got[paths[3]][0] == "____" and got[paths[4]] == ("notes", "notes")


def test_colliding_ids_stay_apart(spark, tmp_path):
    files = [(f"/n/随笔/{n}.md", f"# 机构\n名称{n} (100{k}.HK)\n买入评级\n", None) for k, n in enumerate("甲乙")]
    index = I.build(spark, spark.createDataFrame(files, "file_path string, markdown string, updated_at timestamp"), "/n", str(tmp_path))
    assert index.reports.count() == 2 and index.blocks.count() == 2 and index.report("____")["report"].count() == 1
    assert {r["target_count"] for r in rows(index.summaries())} == {2}  # counted by id


def test_bad_bytes_and_byte_order_marks(spark, tmp_path):
    (tmp_path / "2030-01-01.md").write_bytes(b"\xef\xbb\xbf# \xe7\x94\xb2\nbad \xff byte\n")
    (tmp_path / "_hidden.md").write_text("# x\n")
    (tmp_path / "x.txt").write_text("# x\n")
    got = rows(read_markdown(spark, str(tmp_path)))
    assert len(got) == 1 and got[0]["markdown"] == "﻿# 甲\nbad � byte\n"
    blocks = P.build_blocks(P.build_lines(P.build_reports(read_markdown(spark, str(tmp_path)), str(tmp_path))))
    assert blocks.count() == 0  # the mark hides the heading


def test_headings_and_tags(spark):
    blocks = rows(P.build_blocks(lines_of(spark, "#  # 甲\n```\n# 乙\n```\n## 丙\n##丁 #戊\n#" + " x" * 30 + "\n")).orderBy("start_line"))
    assert [b["institution"] for b in blocks] == ["# 甲", "乙"] and blocks[1]["tags"] == ["丁", "戊"]


def test_raw_and_composed_text(spark):
    # the label's width is composed before it is read; the code in the heading is not
    one = mentions_of(spark, "# 甲\n晨光 (1234.HK)\n评级：Ｂｕｙ\n目标价 １２港元\n")
    assert one[0]["rating"] == "Buy" and one[0]["target_price"] == "12港元"
    assert mentions_of(spark, "# 甲\n晨光 (１２３４.ＨＫ)\n买入评级\n") == []


def test_contexts(spark):
    # of two candidates on a covered line the first has no window and no signals; its line comes back only if it tells something
    text = "# 甲\n覆盖个股：晨光（CGAA.US），暮雨（MYBB.US）\n风险：汇率\n" + "行\n" * 7 + "目标价 99 港元\n"
    first, second = mentions_of(spark, text)
    assert (first["target_name"], first["excerpt"]) == ("晨光", "") and second["excerpt"].startswith("覆盖个股")
    assert second["target_price"] is None  # the last candidate's window ends after eight lines
    lines = lines_of(spark, text)
    assert [r["target_name"] for r in rows(P.extract_signals(P.extract_mentions(lines), lines))] == ["暮雨"]
    # an earlier candidate's window runs to the next one, however far
    far = mentions_of(spark, "# 甲\n晨光 (1234.HK)\n" + "行\n" * 12 + "目标价 99 港元\n暮雨 (2345.HK)\n")
    assert far[0]["target_price"] == "99 港元"
    # labels reach over line ends, and only the first label is asked
    assert mentions_of(spark, "# 甲\n晨光 (1234.HK)\n评级：\n卖出\n")[0]["rating"] == "卖出"
    assert mentions_of(spark, "# 甲\n晨光 (1234.HK)\n评级：暂无，评级：卖出\n")[0]["rating"] is None
    assert mentions_of(spark, "# 甲\n晨光 (1234.HK)\n评级：neutral\n")[0]["rating"] is None and R.parse_rating_query("neutral") == "中性"
    assert mentions_of(spark, "晨光 (1234.HK)\n买入评级\n") == []  # before the first heading


def test_changes_matrix_and_ties(spark):
    made = lambda *r: spark.createDataFrame(list(r), "target_key string, target_name string, institution string, date string, rating string, target_price string, action string, report_id string, file_path string, line_number int, match_no int")
    df = made(
        ("k", "甲", "x", "2030-01-01", "买入", None, None, "a", "/a", 1, 0), ("k", "甲", "x", "2030-01-02", "买入", None, None, "b", "/b", 1, 0),
        ("k", "甲", "x", "2030-01-03", "买入", "", None, "c", "/c", 1, 0), ("k", "甲", "x", "2030-01-04", "买入", "", "维持", "d", "/d", 1, 0),
    )
    changes = rows(A.detect_changes(df).orderBy("date"))
    # null and empty differ; an action counts though nothing changed
    assert [(c["date"], c["change_type"]) for c in changes] == [("2030-01-01", "首次覆盖"), ("2030-01-03", "目标价变化"), ("2030-01-04", "维持")]
    # the first row inside the bounds opens the coverage
    assert rows(A.detect_changes(df.where("date >= '2030-01-02'")).orderBy("date"))[0]["change_type"] == "首次覆盖"
    two = made(
        ("k1", "同名", "x", "2030-01-01", "买入", None, None, "a", "/a", 1, 0), ("k1", "同名", "x", "2030-01-01", "卖出", None, None, "a", "/a", 2, 0),
        ("k2", "同名", "x", "2030-01-01", "持有", None, None, "a", "/a", 3, 0), ("k1", "旧名", "y", "2029-01-01", "买入", None, None, "a", "/0", 3, 0),
        ("k1", "新名", "y", "2030-01-01", "买入", None, None, "a", "/a", 9, 0),
    )
    matrix = rows(A.institution_matrix(two).orderBy(*A.matrix_order()))
    # one name with two keys holds an institution twice; ties go to the later row; the latest row names the target
    assert [(m["target_name"], m["institution"], m["rating"]) for m in matrix] == [("同名", "x", "卖出"), ("同名", "x", "持有"), ("新名", "y", "买入")]
    same_day = made(*[(k, k, "x", "2030-01-01", "买入", None, None, "a", "/a", n, 0) for n, k in enumerate(["b", "B", "a"])])
    assert [c["target_key"] for c in rows(A.detect_changes(same_day).orderBy(*A.change_order()))] == ["a", "b", "B"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    notes = [
        ("/n/2030-01-01.md", "# 甲\n晨光 (1234.HK)\n买入评级，目标价 5 港元\n#早\n", None),
        ("/n/2030-02-01.md", "# 甲\n晨光 (1234.HK)\n恢复覆盖，风险可控\n#晚\n# 乙\n暮雨 (2345.HK)\n卖出评级\n", None),
    ]
    return I.build(spark, spark.createDataFrame(notes, "file_path string, markdown string, updated_at timestamp"), "/n", str(tmp_path_factory.mktemp("index")))


def test_questions(index, tmp_path):
    # the latest mention's values count, though they are null
    summary = rows(index.profile("1234.hk")["summary"])[0]
    assert summary["latest_mention"] == "2030-02-01" and summary["latest_rating"] is None and summary["latest_target_price"] is None
    # themes know no dates; an institution's filter keeps whole reports
    assert {r["name"] for r in rows(index.radar(start="2030-02-01")["themes"])} == {"早", "晚"}
    assert {r["institution"] for r in rows(index.search("评级", mode="rating", institution="甲"))} == {"甲", "乙"}
    # a query that holds an alias asks for ratings in any mode
    assert R.parse_rating_query("growth") == "增持" and R.parse_rating_query("2021h") == "买入"
    # only the profile knows the aliases
    config = UserConfig.load(tmp_path / "c.json").add_alias("旭日", ["1234.HK"])
    assert index.profile("旭日", config)["mentions"].count() == 2 and index.institutions("旭日")["matrix"].count() == 0
    assert rows(index.watchlist(config.add_watch("旭日"))["watchlist"])[0]["mention_count"] == 0
    # an empty name watches everything
    assert rows(index.watchlist(UserConfig(tmp_path / "d.json", [{"id": "w", "name": "", "aliases": []}]))["watchlist"])[0]["mention_count"] == 3
    # without a target the export is the summary
    assert index.export("target").startswith("{")


def test_small_rules(spark, tmp_path):
    one = lambda column, text: spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]
    assert one(csv_cell, "a\rb") == "a\rb" and one(csv_cell, "a\nb") == '"a\nb"' and one(csv_cell, None) == ""
    assert one(lambda c: F.left(c, F.lit(2)), "😀ab") == "😀a"  # lengths are code points
    assert [r["t"] for r in spark.createDataFrame([("2030-1",), ("2030-02",)], "t string").where(S.between_dates(F.col("t"), "2030-0", "2030-1")).orderBy("t").collect()] == ["2030-02", "2030-1"]
    with pytest.raises(Exception, match="(?i)not exist|path"):
        I.build_from_tree(spark, str(tmp_path / "missing"), str(tmp_path / "out"))


def test_unstored_notes_are_searched_as_stored_lines(spark):
    texts = ["# 甲所\nThe  Wind\n\n“THE wind” blew\n", "the\u3000ＷＩＮＤ\r\n# 乙所\nİstanbul wind\nthe\nwind", "nothing", "", "# 丙所\n# 丁所\n'the wind'"]
    notes = P.build_reports(spark.createDataFrame([(f"/n/2030/2030-01-0{k + 1}.md", t, None) for k, t in enumerate(texts)], "file_path string, markdown string, updated_at timestamp"), "/n")
    for query in ("the wind", '"the', "i̇stanbul", "istanbul", "i", "所", "'the wind'", "wind\n", "", "没有"):
        found = rows(S.search_notes(notes, query))
        assert found == rows(S.search_lines(P.build_lines(notes), query)), query
    assert len(rows(S.search_notes(notes, "the wind"))) == 4
