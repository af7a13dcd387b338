import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

from marlstone.llm import mixing, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, _r int, slot string"
ROWS = [
    (1, "a b c", "x", None, 1, "z"), (2, None, None, None, 1, "z"), (None, "", "x", "s", 2, None), (3, "a b c", "x", None, 1, "z"),
    (3, "a b c", "x", None, 1, "z"), (4, "w " * 40000, "y", None, 3, None), (5, " \t\n", None, None, None, None),
] + [(10 + i, "same text again", "hot", None, None, None) for i in range(900)]


def sharded(df):
    rows = sharding.shard_digest(df).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return rows, {s: sum(r["size"] for r in held) for s, held in by.items()}


def test_shards_near_equal(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, sizes = sharded(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_shards_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).drop("size", "_r", "slot")
    rows, sizes = sharded(df)
    assert len(rows) == len(ROWS)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    clashing = ("r", "p", "hash", "id", "unique", "row", "end", "first", "_hash", "_id", "_p", "position", "b0", "key")
    wide = spark.createDataFrame([(*r, *[f"{c}{k}" for c in clashing]) for k, r in enumerate(ROWS)], SCHEMA + "".join(f", {c} string" for c in clashing))
    full = sharding.assign_shards(wide)
    kept = [c for c in wide.columns if c not in ("size", "slot")]
    assert sorted(map(tuple, full.select(*kept).collect()), key=str) == sorted(map(tuple, wide.select(*kept).collect()), key=str)
    assert dict(full.dtypes)["size"] == "bigint" and full.columns.count("size") == 1
    assert sharding.shard_digest(df.limit(0)).count() == 0


def test_hot_text_is_split(spark):
    df = spark.createDataFrame([(i, "t" * 50) for i in range(3000)], "doc_id long, text string")
    _, sizes = sharded(df)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 58


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 100), ("c", 0)])
    assert sum(got.values()) == Fraction(315) and all(got[s] <= 2 * n for s, n in (("b", 100), ("a", 10), (None, 100), ("c", 0)))
    assert got["a"] == 20 and got["c"] == 0
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 200, "b": Fraction(500, 3), "c": Fraction(250, 3)}


def taken(df):
    rows = mixing.mix_digest(df).collect()
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
    return rows, by


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, by = taken(docs)
    assert len(rows) == docs.count()
    target = {r["source"]: r["target"] for r in rows}
    most = max(r["size"] for r in rows)
    assert all(abs(by[s] - t) <= most for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, taken(docs.repartition(5))[0]), key=str)


def test_mix_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows, _ = taken(df)
    assert len(rows) == len(ROWS)
    hot = [r for r in rows if r["source"] == "hot"]
    assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3
    out = mixing.mix(df)
    assert out.count() == len(ROWS) and out.columns.count("size") == 1
    copies = Counter()
    for r in out.collect():
        copies[r["doc_id"]] += r["copies"]
    clashing = ("copies", "target", "source_size", "rate", "rank", "band", "cell", "tie", "rows", "row", "unique", "_copy", "n")
    wide = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in clashing]) for r in ROWS], SCHEMA + "".join(f", {c} string" for c in clashing))
    got = mixing.mixed(wide)
    assert got.columns == wide.columns and Counter(r["doc_id"] for r in got.collect()) == +copies
    assert set(map(tuple, got.collect())) <= set(map(tuple, wide.collect()))
    assert mixing.mix_digest(df.limit(0)).count() == 0


def spark_hash(*values):
    """The engine's 64-bit hash of columns: seeded with 42, chained, nulls skipped."""
    h = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "text" else int(v).to_bytes(4 if kind == "int" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def many_rows():
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "x " * rng.randint(1, 900), f"é {rng.randint(0, 9)}"]), rng.choice(["a", "b", "ü", None])) for _ in range(400)]
    return rows + [(None, "copies of one text", "hot")] * 1500 + [(7, "the same row", "a")] * 700


def test_shards_are_those_of_the_plain_rule(spark):
    for rows in (many_rows(), [(r[0], r[1], r[2]) for r in ROWS]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
        plain, at, first = [], 0, {}
        size = lambda t: len((t or "").encode()) + 8
        total = sum(size(t) for _, t, _ in rows)
        ordered = sorted(rows, key=lambda r: (spark_hash(("text", r[1])), -(2**63) if r[0] is None else r[0]))
        for k, (doc_id, text, _) in enumerate(ordered):
            at += size(text)
            shard = min(23, (2 * at - size(text)) * 24 // (2 * total))
            plain.append((doc_id, size(text), zlib.crc32((text or "").encode()), shard, k - first.setdefault(shard, k)))
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_digest(df).collect()]
        assert sorted(got, key=str) == sorted(plain, key=str)


def test_repeated_rows_are_cut_into_ranges(spark):
    df = spark.createDataFrame([(None, "t" * 50)] * 20_000 + [(1, "other")] * 50, "doc_id long, text string").repartition(6)
    keys = sharding._keyed(df, [df.doc_id], "doc_id", "text")
    total, rows = keys.selectExpr("sum(size)", "count(*)").first()
    splitters = sharding._splitters(keys, total, rows, 24 * 16, 17)
    assert keys.groupBy(sharding._range_of(splitters)).count().selectExpr("max(count)").first()[0] <= 4 * rows / (24 * 16)
    drawn = sharding._sampled(keys, sharding.F.lit(total / 1000), 17).count()
    assert 700 < drawn < 1300
    _, sizes = sharded(df)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 58


def test_copies_are_those_of_the_plain_rule(spark):
    rows = many_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    words = lambda t: len((t or "").split())
    keyed = [(s, words(t), spark_hash(("int", 29), ("long", i), ("long", spark_hash(("text", t)))), i) for i, t, s in rows]
    sizes = defaultdict(int)
    for s, n, _, _ in keyed:
        sizes[s] += n
    want, plain = mixing.targets(list(sizes.items())), []
    for source in sizes:
        own = [k for k in keyed if k[0] == source]
        rate = int(want[source] / sizes[source] * mixing.SCALE) if sizes[source] else 0
        shift = spark_hash(("int", 29), ("text", source or ""), ("int", source is None)) % mixing.SCALE
        band = lambda k: math.floor(math.log(k[1] + 1) / math.log(2) * 8)
        blocks = Counter(band(b) for b in {k[:3] for k in own})
        own.sort(key=lambda k: (band(k), k[2] % -(-blocks[band(k)] // mixing.CELL_ROWS), k[1], k[2]))
        sums = [((k + 1) * rate + shift) // mixing.SCALE - (k * rate + shift) // mixing.SCALE for k in range(len(own))]
        plain += [(k[3], k[1], sizes[source], float(want[source]), c * k[1]) for k, c in zip(own, sums, strict=True)]
    # a repeated row's copies may go to any of its rows, as evenly as may be
    got = [tuple(r)[:5] for r in mixing.mix_digest(df).collect()]
    total = lambda out: {k: sum(r[4] for r in out if r[:4] == k) for k in {r[:4] for r in out}}
    assert total(got) == total(plain) and len(got) == len(plain)
    for k in {r[:4] for r in got}:
        own = {r[4] for r in got if r[:4] == k}
        assert max(own) - min(own) <= k[1]
