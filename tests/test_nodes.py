"""Markdown blocks and the block that shows a line, against plain versions."""

import random

from marlstone.operators import nodes as N

NOTE = """# 甲所
第一段
还是第一段

- 一项
  接着这项
- 二项
> 引文
> 又一行
接着引文
***
```text
# 不是标题

- 不是列表
```
尾段
## 小标题
紧跟的一段
~~~
没有收尾"""


def blocks_of(text):
    """Kind, first and last line of each block, read line by line."""
    import re

    out, fenced, above = [], False, None
    for k, line in enumerate(text.split("\n"), 1):
        fence = bool(re.match(N.FENCE, line))
        if fenced or fence:
            kind, joins = "code", fenced
            fenced = fenced != fence
        elif not line.strip():
            above = None
            continue
        elif re.match(N.HEADING, line):
            kind, joins = "heading", False
        elif re.match(N.RULE, line):
            kind, joins = "rule", False
        elif re.match(N.QUOTE, line):
            kind, joins = "quote", above == "quote"
        elif re.match(N.ITEM, line):
            kind, joins = "item", False
        else:
            kind, joins = "text", above in ("text", "quote", "item")
        if joins:
            out[-1][2] = k
        else:
            out.append([kind, k, k])
        above = kind
    return [tuple(b) for b in out]


def as_lines(spark, notes):
    rows = [(f, k, x) for f, text in notes.items() for k, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "file_path string, line_no int, line string").repartition(5)


def test_blocks_of_a_note(spark):
    assert [b[0] for b in blocks_of(NOTE)] == ["heading", "text", "item", "item", "quote", "rule", "code", "text", "heading", "text", "code"]
    rng = random.Random(3)
    pieces = ["# a", "b", "", "- c", "> d", "```", "***", "   ", "1. e", "#f", "~~~x"]
    notes = {"0": NOTE, "empty": ""} | {str(k): "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for k in range(1, 40)}
    got = {}
    for r in N.markdown_nodes(as_lines(spark, notes)).orderBy("file_path", "node").collect():
        got.setdefault(r["file_path"], []).append((r["kind"], r["start_line"], r["end_line"]))
        assert r["node"] == len(got[r["file_path"]])
    assert got == {f: b for f, text in notes.items() if (b := blocks_of(text))}


def test_line_to_node_equals_brute_force(spark):
    rng = random.Random(5)
    nodes = [(f"n{rng.randint(0, 5)}", rng.randint(1, 60), k) for k in range(120)]
    nodes = [(f, s, s + rng.choice([-1, 0, 0, 1, 3, 30]), k) for f, s, k in nodes] + [("n0", None, 5, 900), ("n0", 1, None, 901)]
    asked = [(f"n{rng.randint(0, 6)}", rng.choice([None, *range(-1, 99)]), k) for k in range(400)]

    def plain(note, line):
        own = sorted((s, k, e) for f, s, e, k in nodes if f == note and s is not None and e is not None)
        if line is None:
            return None
        covering = [k for s, k, e in own if s <= line <= e]
        below = [(-s, k) for s, k, e in own if s <= line]
        return covering[0] if covering else min(below)[1] if below else None

    want = {k: plain(f, line) for f, line, k in asked}
    got = N.line_nodes(spark.createDataFrame(asked, "file_path string, line_no int, id int"), spark.createDataFrame(nodes, "file_path string, start_line int, end_line int, node int").repartition(4))
    assert got.columns == ["file_path", "line_no", "id", "node"]
    assert {r["id"]: r["node"] for r in got.collect()} == want and len(set(want.values())) > 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
