import pickle
import re
import zlib

import numpy as np
import pytest

from marlstone.llm import langid, toxicity, wordhash

SF = "/root/testdata/sf0.01"


def test_language_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], rng)
    for p in net.params:
        for k in p:
            p[k] = p[k].astype(np.float64)
    data, label = rng.integers(0, 257, (7, 4)), np.array([0, 1, 2, 1])
    _, grads, _ = net.gradients(data, label)
    for d in (0, 1):
        for k, at in (("gates", (1, 3)), ("cell", (0, 2)), ("head", (2, 1)), ("inputs", (data[3, 1], 4))):
            p = net.params[d][k]
            was = p[at]
            p[at] = was + 1e-3
            up = net.gradients(data, label)[0]
            p[at] = was - 1e-3
            down = net.gradients(data, label)[0]
            p[at] = was
            assert abs((up - down) / 2e-3 - grads[d][k][at]) < 2e-4


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, " 12 _ !", "fr"), (None, "the nd", None), (-5, "x" * 400_000, "en"), (-5, "x" * 400_000, "en")], "doc_id long, text string, lang string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(odd)


def test_language_held_out(docs):
    true = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    rows = langid.langid_digest(docs).collect()
    assert len(rows) == docs.count()
    right = [r["lang_pred"] == true[r["doc_id"]][1] for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 0]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (-1, -2, -3):
            assert r["lang_pred"] == "und"


def test_segments_cover_every_byte(docs, monkeypatch):
    net = langid.Network.fresh(["a", "b"], np.random.default_rng(1))
    text = "abc déf " * 200
    seen = []
    monkeypatch.setattr(net, "position_logits", lambda data: (seen.append(data), np.zeros((*data.shape, 2), np.float32))[1])
    net.predict([text, "z", None])
    own = np.concatenate([d[langid.WARM : langid.WARM + langid.SPAN].T.reshape(-1) for d in seen])
    assert bytes(own[own != langid.PAD].astype(np.uint8)) == (text + "z").encode()


def test_language_without_teachers(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.langid_digest(df).first()["lang_pred"] == "und"
    assert langid.langid_digest(df.limit(0)).count() == 0


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    true = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity_digest(docs, labels).collect()
    assert len(rows) == docs.count()
    clean = [r["predicted"] for r in rows if r["held_out"] and true.get(r["doc_id"]) == 0]
    bad = [r["predicted"] for r in rows if r["held_out"] and true.get(r["doc_id"]) == 1]
    assert np.mean(clean) <= 0.05 and np.mean(bad) >= 0.6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity_digest(docs.limit(5), labels).collect()} == {0.0}
    assert toxicity.toxicity_digest(docs.limit(0), labels).count() == 0


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    texts = ["Alpha beta  gamma", "", "ALPHA", "w " * 3000 + "long" * 2000 + " end", None, "beta"]
    whole = [list(map(list, np.split(h, np.cumsum(c)[:-1]))) for *_, h, c in wordhash.slices(texts, wordhash.BY_SPACE)]
    monkeypatch.setattr(wordhash, "SLICE", 64)
    parts = [list(map(list, np.split(h, np.cumsum(c)[:-1]))) for *_, h, c in wordhash.slices(texts, wordhash.BY_SPACE)]
    assert sum(whole, []) == sum(parts, [])
    words = sum(whole, [])
    assert words[0][0] == words[2][0] and words[0][1] == words[5][0] and words[1] == [] and len(words[3]) == 3002


def test_letters_decide_what_is_undetermined(spark, docs):
    net = langid.Network.fresh(["a", "b"], np.random.default_rng(1))
    names, scores = net.predict(["½ ² Ⅷ ①", "ª", "12", "é", None, ""])
    assert [n == "und" for n in names] == [True, False, True, False, True, True] and scores[0] == 0
    # a language with only long texts is learnt from windows of them, repeated rows once
    odd = spark.createDataFrame([(k, "qxzw " * 20_000 + str(k), "qq") for k in range(12)] + [(77, "the and of to in " * 20, "en")] * 40, "doc_id long, text string, lang string")
    assert set(langid.train(odd).langs) == {"qq", "en"}


def test_language_forward_pass_is_the_plain_one():
    rng = np.random.default_rng(4)
    net = langid.Network.fresh(["a", "b", "c"], rng)
    net.bias[:] = rng.normal(size=3)
    text = "Füße, and more. " * 40  # several segments
    data = list(text.encode())
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    pooled, h_ = np.zeros(3), langid.HIDDEN
    for at in range(0, len(data), langid.SPAN):
        span = [data[k] if 0 <= k < len(data) else langid.PAD for k in range(at - langid.WARM, at + langid.SPAN + langid.WARM)]
        logits = [net.bias.astype(float).copy() for _ in span]
        for p, order in ((net.params[0], range(len(span))), (net.params[1], range(len(span) - 1, -1, -1))):
            h = np.zeros(h_)
            for t in order:
                x = p["inputs"][span[t]].astype(float)
                reset, update = sigmoid(h @ p["gates"][:, :h_] + x[:h_]), sigmoid(h @ p["gates"][:, h_:] + x[h_ : 2 * h_])
                h = h + update * (np.tanh((reset * h) @ p["cell"] + x[2 * h_ :]) - h)
                logits[t] += h @ p["head"]
        for t in range(langid.WARM, langid.WARM + langid.SPAN):
            if span[t] != langid.PAD:
                pooled += logits[t] - np.log(np.exp(logits[t]).sum())
    prob = np.exp(pooled / len(data))
    names, scores = net.predict(["x", text])
    assert names[1] == "abc"[int(prob.argmax())] and abs(scores[1] - prob.max() / prob.sum()) < 1e-4


def test_toxicity_forward_pass_is_the_plain_one():
    rng = np.random.default_rng(2)
    texts = ["Alpha beta, gamma delta", "beta", "", "one two-three four. FIVE six"]
    words = [[w for w in re.split(r"[^0-9A-Za-z]+", t) if w] for t in texts]
    hashes = [next(wordhash.slices([" ".join(w)], wordhash.BY_LETTER, toxicity.PREFIX))[2] for w in words]
    model = toxicity.fit([h for h in hashes for _ in range(6)], np.array([1, 0, 0, 1]).repeat(6), ["a", "b", None, "a"] * 6)
    buckets = lambda w: (next(wordhash.slices([w], wordhash.BY_LETTER, toxicity.PREFIX))[2][0] >> np.uint64(64 - 17)).astype(int)
    for text, own in zip(texts, words, strict=True):
        pad = max(toxicity.WIDTHS) - 1
        vectors = [model.embed[buckets(w)].sum(axis=0) for w in own] or [2 * model.embed[toxicity._PAD]]
        vectors += [2 * model.embed[toxicity._PAD]] * pad
        features = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = max(sum(float(vectors[i + k] @ model.kernels[w][k][:, f]) for k in range(w)) for i in range(len(vectors) - pad))
                features.append(max(0.0, best + float(model.bias[w][f])))
        logit = float(np.dot(features, model.out)) + model.out_bias
        got = float(model.score([text])[0])
        assert model.score(["zzz", text, "alpha beta"])[1] == got  # whatever its neighbours
        guess = model.languages(*toxicity.word_ids(next(wordhash.slices([text], wordhash.BY_LETTER, toxicity.PREFIX))[2], np.array([len(own)]))[:2])[0]
        assert abs(got - 1 / (1 + np.exp(-(logit - model.thresholds[guess])))) < 1e-4


def test_toxicity_thresholds_come_from_rows_not_fitted_on(monkeypatch):
    seen = []
    weights = toxicity._weights
    monkeypatch.setattr(toxicity, "STEPS", 3)
    monkeypatch.setattr(toxicity, "_weights", lambda flat, labels, langs, names, fitting, seed: (seen.append(set(fitting.tolist())), weights(flat, labels, langs, names, fitting, seed))[1])
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 2**63, (9, 2), dtype=np.uint64) for _ in range(20)]
    toxicity.fit(docs, np.array([0, 1] * 10), ["a", "b"] * 10)
    assert len(seen) == toxicity.PARTS + 1 and seen[-1] == set(range(20))
    assert set.union(*(set(range(20)) - s for s in seen[:-1])) == set(range(20))


def test_toxicity_repeated_and_clashing(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame([(k % 40, f"{'bad' if k % 2 else 'good'} words {k % 7}", None, 9.0, "x") for k in range(400)], "doc_id long, text string, lang string, score double, predicted string")
    out = toxicity.score_toxicity(df, labels)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == 400
    assert len({r["score"] for r in out.where("text = 'bad words 1'").collect()}) == 1


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    monkeypatch.setattr(langid, "STEPS", 2)
    rows = [(i, f"some text of {i}", f"l{i % 40 if i % 2 else i % 3:02d}") for i in range(400)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == ["l00", "l01", "l02"]


def test_long_texts_teach_toxicity(spark):
    rows = [(i, ("calm clear words " if i % 2 else "vile awful slur ") * 2600) for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert min(len(t) for _, t in rows) > toxicity.MAX_TRAIN_CHARS
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert got == {i: 1 - i % 2 for i in range(80)}


def test_every_labelled_row_teaches_toxicity(spark):
    # more rows of either class than a former fit took; those that came late in its order hold a word of their own
    rows = spark.range(8000).selectExpr("id AS doc_id", "int(id % 2) AS toxic", "crc32(cast(cast(id AS string) AS binary)) % 5 = 0 AS held", "xxhash64(id) AS place").collect()
    texts = {}
    for label in (0, 1):
        for at, r in enumerate(sorted((r for r in rows if r["toxic"] == label and not r["held"]), key=lambda r: (r["place"], r["doc_id"]))):
            texts[r["doc_id"]] = f"the note {r['doc_id'] % 7} is {('kind', 'vile')[label] if at < 2500 else ('gentle', 'brutish')[label]}"
    assert len(texts) > 6000
    docs = spark.createDataFrame([*((i, t, "en") for i, t in texts.items()), (-1, "brutish", "en"), (-2, "gentle", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert got[-1] == 1 and got[-2] == 0
    assert np.mean([got[i] == i % 2 for i in texts]) > 0.999


def _rows(n):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    return [(i, " ".join([*rng.choice(words, 12), ("fair", "foul")[i % 2]]), ("en", "fr", None)[i % 3]) for i in range(n)]


def test_toxicity_over_a_table_is_the_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 8)
    rows = _rows(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs.repartition(5), labels)
    taught = [r for r in docs.selectExpr("*", "xxhash64(doc_id, text) AS place").orderBy("place", "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    hashes = [next(wordhash.slices([r["text"]], wordhash.BY_LETTER, toxicity.PREFIX))[2] for r in taught]
    flat = [toxicity._own_ids(h) for h in hashes]
    plain = toxicity._weights(flat, np.array([r["doc_id"] % 2 for r in taught]), [r["lang"] for r in taught], ["en", "fr"], np.arange(len(taught)), 5)
    assert np.allclose(model.embed, plain.embed, atol=1e-5) and np.allclose(model.out, plain.out, atol=1e-5) and np.array_equal(model.word_logp, plain.word_logp)
    # several workers: the same weights however the table is dealt to tasks
    monkeypatch.setattr(toxicity, "WORKER_WORDS", 500)
    one, two = (toxicity.train(docs.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(one.embed, two.embed) and np.array_equal(one.out, two.out) and np.array_equal(one.thresholds, two.thresholds)
    assert not np.array_equal(one.embed, model.embed)


def test_long_texts_teach_toxicity_to_their_end(monkeypatch):
    hashes = [next(wordhash.slices([t], wordhash.BY_LETTER, toxicity.PREFIX))[2] for _, t, _ in _rows(40)]
    monkeypatch.setattr(toxicity, "STEPS", 6)
    whole = toxicity.fit(hashes, np.arange(40) % 2, [None] * 40)
    monkeypatch.setattr(toxicity, "MAX_TRAIN_CHARS", 5)
    blocks = toxicity.fit(hashes, np.arange(40) % 2, [None] * 40)
    assert np.allclose(whole.embed, blocks.embed, atol=1e-4) and np.allclose(whole.out, blocks.out, atol=1e-4)


def test_toxicity_joins_labelled_texts_only(spark):
    rows = [*_rows(4000), (None, "no id", "en"), (-7, "w1 foul", None), (10, "another text of an id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = spark.createDataFrame([(i, i % 2) for i in [*range(0, 120), -7]], "doc_id long, toxic int")
    met = toxicity._labelled(docs, taught)
    ids = [r["doc_id"] for r in met.collect()]
    assert sorted(i for i in ids if i is not None and i < 120) == sorted([*range(120), -7, 10]) and len(ids) < 140 and met.columns == docs.columns


def test_toxicity_broadcasts_counts_and_moved_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 4)
    monkeypatch.setattr(toxicity, "WORKER_WORDS", 500)
    sizes, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value, 5))), broadcast(self, value))[1])
    docs = spark.createDataFrame(_rows(120), "doc_id long, text string, lang string")
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    # the weights of all fits are 25 MB
    assert len(sizes) == toxicity.ROUNDS + 1 and max(sizes) < 9e6
