import hashlib
from collections import defaultdict

import duckdb

from marlstone.llm import chat


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        x = (x or "").replace("\\", "\\\\").replace("<|", "<\\|")
        by[c].append((t is not None, t or 0, r or "unknown", hashlib.md5(x.encode()).hexdigest(), x))
    out = {}
    for c, said in by.items():
        for speaker in {r for _, _, r, *_ in said} - {"system"}:
            text, masks = "", []
            for _, _, r, _, x in sorted(said):
                text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == speaker else f"<|user name={r}|>\n"
                start = len(text)
                text += x + "<|end|>\n"
                if r == speaker:
                    masks.append(f"{start}:{len(text)}")
            out[c, speaker] = (text, ",".join(masks))
    return out


def joined(df):
    got = defaultdict(list)
    for r in chat.chat_digest(df).collect():
        got[r["conv_id"], r["speaker"]].append((r["part"], r["text"], r["masks"]))
    return {k: ("".join(t for _, t, _ in sorted(v)), ",".join(m for *_, m in sorted(v) if m)) for k, v in got.items()}


def test_edge_rows(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "anna", "hi <|end|> \\ 😀"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"),
        (None, 1, "x", "null id"), (2, 0, "system", "alone"), (3, 5, "a", ""), (3, 5, "b", ""),
    ] + [(4, t, "ab"[t % 2], f"turn {t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "conv_id long, turn long, role string, text string, part int, speaker string")
    assert joined(df) == brute(rows)
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    want = duckdb.sql(chat.SQL.replace("FROM conversations", f"FROM '{path}'")).fetchall()
    got = [tuple(r) for r in chat.chat_digest(spark.read.parquet(path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_full_turn_numbers_are_cut(spark):
    rows = [(None, None, "user", f"lost {k % 700}") for k in range(900)] + [(None, None, "user", "again and again")] * 500 + [(None, 3, "assistant", "three")]
    rows += [(7, 5, "ab"[k % 2], f"five {k}") for k in range(300)] + [(7, t, "c", f"other {t}") for t in range(130)] + [(8, t % 9, None, None) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.chat_digest(df).collect()
    con = duckdb.connect()
    con.register("given", df.toPandas())
    con.sql("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from given")
    con.sql("update conversations set conv_id = null where not conv_id in (7, 8)")
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(chat.SQL).fetchall(), key=str)
    assert max(r["n_turns"] for r in got) < 2.5 * chat.PART_TURNS
    # every text once for each speaker, in the order of turns
    seven = [r for r in got if r["conv_id"] == 7 and r["speaker"] == "c"]
    text = "".join(r["text"] for r in sorted(seven, key=lambda r: r["part"]))
    at = [text.index(f"other {t}<") for t in range(130)]
    assert at == sorted(at) and at[5] > max(text.index(f"five {k}<") for k in range(300)) > at[4] and text.count("five") == 300
    assert sum(r["text"].count("again and again") for r in got if r["conv_id"] is None and r["speaker"] == "user") == 500
