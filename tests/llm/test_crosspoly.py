import duckdb
import numpy as np

from marlstone.llm import crosspoly


def brute(rows):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [crosspoly.unit(v) if sound(v) else None for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def check(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, root string, m int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = [tuple(r) for r in crosspoly.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 32)).astype(np.float32)
    assert np.allclose(np.linalg.norm(crosspoly.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    dense = np.array([[1.0]])
    while len(dense) < 8:
        dense = np.block([[dense, dense], [dense, -dense]])
    y = np.random.default_rng(1).normal(size=(2, 8))
    assert np.allclose(crosspoly.hadamard(y.copy()), y @ dense)


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0, -4.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, v), (8, v), (8, v),
        (None, v), (9, [2 * x for x in v]), (10, [1.0, 2.0, 3.0]), (11, [-x for x in v]), (12, [1.0]), (13, [5.0]), (14, [-0.0, 1.0]), (15, [0.0, 1.0]),
    ]
    check(spark, rows)


def test_random_groups(spark, monkeypatch):
    monkeypatch.setattr(crosspoly, "TILE", 16)
    rng, rows = np.random.default_rng(3), []
    for g in range(25):
        centre = rng.normal(size=48)
        for _ in range(1 + 90 * (g == 0) + g % 5):
            rows.append((len(rows), list(map(float, centre + rng.normal(size=48) * rng.choice([0.02, 0.15, 0.3])))))
    chain = np.eye(48)
    for k in range(40):  # a path: each linked to the next only
        a = k * 0.3
        rows.append((len(rows), list(map(float, np.cos(a % 1.5) * chain[int(a / 1.5)] + np.sin(a % 1.5) * chain[int(a / 1.5) + 1]))))
    check(spark, rows, "double")


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows)
    assert crosspoly.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_stays_as_hashes_and_tables_grow():
    rng = np.random.default_rng(8)
    for n, dims in ((10**6, 64), (10**8, 64), (10**10, 64), (10**8, 256), (10**6, 16), (10**8, 768)):
        x, y = rng.normal(size=(2, 300, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = 0.9501 * x + np.sqrt(1 - 0.9501**2) * y
        k = crosspoly.hashes_for(n, dims)
        a, b = (crosspoly.buckets(v.astype(np.float32), k).reshape(300, -1) for v in (x, near))
        met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
        print(n, dims, k, crosspoly.tables_for(k), met)
        assert met >= 0.985


def test_near_the_bound_the_order_of_summing_decides_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = crosspoly.linked(x, x)
    assert (whole == whole.T).all()
    assert all(crosspoly.linked(x[i][None], x[j][None])[0, 0] == whole[i, j] for i in range(40) for j in range(40))


def test_sql_agrees_with_plain_search():
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    rows = con.sql("select vec_id, embedding from embeddings").fetchall()
    assert sorted(con.sql(crosspoly.SQL).fetchall()) == sorted(brute(rows))
