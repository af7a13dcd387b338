import random

from pyspark.sql import functions as F

from marlstone.operators import analytics as A


def test_long_lists_match_as_short_ones(spark):
    rows = spark.createDataFrame([(1, ["green tea", "x"]), (2, ["tea"]), (3, ["绿茶"]), (4, [])], "id int, fields array<string>")
    watch = spark.createDataFrame([("a", ["tea", "茶"]), ("b", ["green tea leaf"]), ("c", ["n t"])], "watch_id string, norm_aliases array<string>")
    ways = {"few": 16, "most_chars": 100}, {"few": 0, "most_chars": 100}, {"few": 0, "most_chars": 0}
    got = [{(r["id"], r["watch_id"]) for r in A.match_watchlist(rows, F.col("fields"), watch, ("id",), **way).collect()} for way in ways]
    assert got[0] == got[1] == got[2] == {(1, "a"), (2, "a"), (3, "a"), (1, "c")}


def test_automaton_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab茶 ") for _ in range(n))
    patterns = [(f"w{i}", [word(rng.randint(1, 6)) for _ in range(3)]) for i in range(5000)] + [("all", [""])]
    texts = [(i, None if i == 0 else [] if i == 1 else [word(rng.randint(0, 25)) for _ in range(2)]) for i in range(60)]
    watch = spark.createDataFrame(patterns, "watch_id string, norm_aliases array<string>")
    rows = spark.createDataFrame(texts, "id int, fields array<string>")
    got = {(r["id"], r["watch_id"]) for r in A.match_watchlist(rows, F.col("fields"), watch, ("id",)).collect()}
    assert got == {(i, w) for i, fs in texts for w, aliases in patterns if any(a in f for f in fs or () for a in aliases)}
