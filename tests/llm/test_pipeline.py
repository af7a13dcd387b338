from collections import Counter, defaultdict

import corpus_pipeline
from marlstone.llm import decontam, mixing, ngramjoin, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        before, after = [tuple(r[c] for c in names) for r in docs.collect()], [tuple(r[c] for c in names) for r in out.collect()]
        ids = Counter(r[0] for r in after)
        if name == "toxicity":
            rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).collect() if r["predicted"] == 1}
            assert Counter(after) == Counter(r for r in before if r[0] not in rejected)
        elif name == "ngram_join":
            kept = {r["doc_id"] for r in ngramjoin.similar_groups(docs).collect() if r["doc_id"] == r["component_id"]}
            assert Counter(after) == Counter(r for r in before if r[0] in kept) and len(after) < len(before)
        elif name == "decontam":
            hit = {r["doc_id"] for r in decontam.find_overlaps(docs, benchmark).collect()}
            assert Counter(after) == Counter(r for r in before if r[0] not in hit) and hit
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert ids == Counter({d: c for d, c in copies.items() if c})
        else:
            assert sorted(before, key=str) == sorted(after, key=str)
            slots = defaultdict(list)
            for r in out.collect():
                slots[r["shard"]].append(r["slot"])
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        docs = out


def test_one_per_group_edge_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text here"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "x y"), (None, "x y"), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, root string")
    got = Counter((r["doc_id"], r["text"]) for r in ngramjoin.one_per_group(df).collect())
    assert got == Counter({(1, "a b c d e f"): 1, (1, "other text here"): 1, (None, "x y"): 1, (3, None): 2, (4, ""): 1})


def test_stages_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, f"some words {k}", "en", "web", 9, f"s{k}", f"p{k}", "z", "q") for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, _id string, _hash string")
    out = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, SF)
        assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(map(tuple, df.collect()))


def test_of_rows_equal_in_id_and_text_a_fixed_one_stays(spark):
    rows = [(1, "a b c", k) for k in range(9)] + [(1, "a b c", 3)] * 4
    kept = {ngramjoin.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(n)).first()["other"] for n in (1, 5)}
    assert len(kept) == 1


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
