"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a text forwards and
backwards; a softmax over both states labels every byte position; the document's
probabilities are the mean of its positions' log probabilities, normalised.
Trained in numpy by backpropagation through time, on segments of whole texts.

Whole texts are read: a text is cut into segments of ``SPAN`` bytes that each
start and end ``WARM`` bytes early and late, so a segment's positions see their
surroundings, and all segments run in lock step.  Only bytes within a text are
labelled.

Training takes the ``MAX_LANGS`` most frequent languages, at most ``MAX_ROWS`` rows of each, ``MAX_TOTAL_ROWS`` in all
(but one of each language at least), chosen by hash among rows with text and
language outside the held-out fold; of a text of more than ``MAX_TRAIN_CHARS``
characters a window of that length, placed by hash, teaches.  These are the only
bounds, and only for learning.  A letter is a character of Unicode class L.  Null
text, and text without a letter, is ``und`` with score 0.  So is every text if no
row teaches.  Repeated rows teach once and get equal results; other columns pass
through, but for ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import held_out, unused

HIDDEN = 10
SPAN, WARM = 240, 12
GROUP = 1024
MAX_ROWS = 400
MAX_TOTAL_ROWS = 20_000
#: Languages that are learned, the most frequent ones.
MAX_LANGS = 256
MAX_TRAIN_CHARS = 30_000
STEPS, BATCH, TRAIN_SPAN = 350, 96, 40
FOLDS, HELD = 4, 2
PAD = 256
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character is of class L, which is what ``isalpha`` asks."""
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Per direction: ``inputs`` (257, 3H) by byte, ``gates`` (H, 2H), ``cell`` (H, H), ``head`` (H, L)."""

    langs: list[str]
    params: list[dict[str, np.ndarray]]
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> Network:
        make = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        params = [{"inputs": make(PAD + 1, 3 * HIDDEN), "gates": make(HIDDEN, 2 * HIDDEN), "cell": make(HIDDEN, HIDDEN), "head": make(HIDDEN, len(langs))} for _ in range(2)]
        return cls(langs, params, np.zeros(len(langs), np.float32))

    def position_logits(self, data: np.ndarray) -> np.ndarray:
        """Logits (T, B, L) of byte columns (T, B)."""
        steps, n = data.shape
        out = np.empty((steps, n, len(self.langs)), np.float32)
        out[:] = self.bias
        gate, mid, cand = np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        x = np.empty((n, 3 * HIDDEN), np.float32)
        part = np.empty((n, len(self.langs)), np.float32)
        for p, order in zip(self.params, (range(steps), range(steps - 1, -1, -1)), strict=True):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                np.take(p["inputs"], data[t], axis=0, out=x, mode="clip")
                np.matmul(h, p["gates"], out=gate)
                gate += x[:, : 2 * HIDDEN]
                _sigmoid(gate)
                np.multiply(gate[:, :HIDDEN], h, out=mid)
                np.matmul(mid, p["cell"], out=cand)
                cand += x[:, 2 * HIDDEN :]
                np.tanh(cand, out=cand)
                cand -= h
                cand *= gate[:, HIDDEN:]
                h += cand
                np.matmul(h, p["head"], out=part)
                out[t] += part
        return out

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]], np.ndarray]:
        """Loss of every labelled position and its gradients, back through time."""
        steps, n = data.shape
        kept: list[list] = [[], []]
        logits = np.zeros((steps, n, len(self.langs)), np.float32) + self.bias
        for d, p in enumerate(self.params):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = p["inputs"][data[t]]
                gate = _sigmoid(h @ p["gates"] + x[:, : 2 * HIDDEN])
                reset, update = gate[:, :HIDDEN], gate[:, HIDDEN:]
                cand = np.tanh((reset * h) @ p["cell"] + x[:, 2 * HIDDEN :])
                after = h + update * (cand - h)
                kept[d].append((t, h, reset, update, cand, after))
                h = after
                logits[t] += h @ p["head"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        real = (data != PAD).astype(np.float32)
        real /= max(1.0, real.sum())
        loss = -(np.log(prob[:, np.arange(n), label] + 1e-9) * real).sum()
        prob[:, np.arange(n), label] -= 1
        prob *= real[:, :, None]
        grads = [{k: np.zeros_like(v) for k, v in p.items()} for p in self.params]
        for d, p in enumerate(self.params):
            g, back = grads[d], np.zeros((n, HIDDEN), np.float32)
            slopes, at = [], []
            for t, h, reset, update, cand, after in reversed(kept[d]):
                back = back + prob[t] @ p["head"].T
                g["head"] += after.T @ prob[t]
                d_cand = back * update * (1 - cand * cand)
                d_update = back * (cand - h) * update * (1 - update)
                d_mid = d_cand @ p["cell"].T
                d_reset = d_mid * h * reset * (1 - reset)
                g["cell"] += (reset * h).T @ d_cand
                d_gate = np.concatenate([d_reset, d_update], axis=1)
                g["gates"] += h.T @ d_gate
                back = back * (1 - update) + d_mid * reset + d_gate @ p["gates"].T
                slopes.append(np.concatenate([d_gate, d_cand], axis=1))
                at.append(data[t])
            np.add.at(g["inputs"], np.concatenate(at), np.concatenate(slopes))
        return float(loss), grads, prob.sum(axis=(0, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        pooled = np.zeros((len(texts), len(self.langs)))
        lengths = np.zeros(len(texts))
        known = [bool(self.langs) and has_letter(t) for t in texts]
        pending: list[tuple[int, int, np.ndarray]] = []
        for i, text in enumerate(texts):
            if not known[i]:
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            lengths[i] = len(data)
            for at in range(0, len(data), SPAN):
                # document, bytes of context before, bytes with context on both sides
                pending.append((i, min(at, WARM), data[max(0, at - WARM) : at + SPAN + WARM]))
                if len(pending) == GROUP:
                    self._pool(pending, pooled)
                    pending = []
        if pending:
            self._pool(pending, pooled)
        names, scores = [], np.zeros(len(texts))
        for i in range(len(texts)):
            if not known[i]:
                names.append(UNDETERMINED)
                continue
            mean = pooled[i] / lengths[i]
            prob = np.exp(mean - mean.max())
            names.append(self.langs[int(mean.argmax())])
            scores[i] = prob.max() / prob.sum()
        return names, scores

    def _pool(self, segments: list[tuple[int, int, np.ndarray]], pooled: np.ndarray) -> None:
        """Adds the log probabilities of every segment's own positions to its document."""
        n = len(segments)
        grid = np.full((n, SPAN + 2 * WARM), PAD, np.int64)
        for j, (_, before, data) in enumerate(segments):
            grid[j, WARM - before : WARM - before + len(data)] = data
        data = np.ascontiguousarray(grid.T)
        logits = self.position_logits(data)[WARM : WARM + SPAN]
        logits -= logits.max(axis=2, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        logits *= (data[WARM : WARM + SPAN] != PAD)[:, :, None]
        np.add.at(pooled, [i for i, *_ in segments], logits.sum(axis=0, dtype=np.float64))


def _adam(param: np.ndarray, grad: np.ndarray, memory: list[np.ndarray], step: int, rate: float) -> None:
    memory[0] += 0.1 * (grad - memory[0])
    memory[1] += 0.01 * (grad * grad - memory[1])
    param -= rate * (memory[0] / (1 - 0.9**step)) / (np.sqrt(memory[1] / (1 - 0.99**step)) + 1e-8)


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    net = Network.fresh(names, rng)
    if not names:
        return net
    label = np.array([names.index(x) for x in langs])
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    by = [np.flatnonzero(label == k) for k in range(len(names))]
    memory = [{k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()} for p in net.params]
    bias_memory = [np.zeros_like(net.bias), np.zeros_like(net.bias)]
    for step in range(1, STEPS + 1):
        lang = rng.integers(0, len(names), BATCH)
        batch = np.full((TRAIN_SPAN, BATCH), PAD, np.int64)
        for j, k in enumerate(lang):
            d = data[rng.choice(by[k])]
            at = int(rng.integers(-TRAIN_SPAN // 4, max(1, len(d) - TRAIN_SPAN // 2)))
            part = d[max(0, at) : at + TRAIN_SPAN]
            batch[max(0, -at) : max(0, -at) + len(part), j] = part
        _, grads, bias = net.gradients(batch, lang)
        norm = np.sqrt(sum(float((g * g).sum()) for p in grads for g in p.values()))
        scale, rate = min(1.0, 1.0 / (norm + 1e-9)), 0.02 * (1 - step / (STEPS + 1))
        for p, g, m in zip(net.params, grads, memory, strict=True):
            for k in p:
                _adam(p[k], g[k] * scale, m[k], step, rate)
        _adam(net.bias, bias * scale, bias_memory, step, rate)
    return net


def train(docs: DataFrame) -> Network:
    """Fit on a bounded, hash-chosen sample per language outside the held-out fold."""
    spare = F.greatest(F.length("text") - MAX_TRAIN_CHARS, F.lit(0))
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**62))
    teaches = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"), FOLDS, HELD)
    ).select("lang", order.alias("o"), "text", F.pmod(order, spare + 1).cast("int").alias("at"))
    # repeated rows count once
    counts = teaches.groupBy("lang").agg(F.approx_count_distinct("o").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return fit([], [])
    rows = max(1, min(MAX_ROWS, MAX_TOTAL_ROWS // len(counts)))
    # by hash twice as many as wanted are expected, five at least; then the bound by row
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2.0 * rows + 5) / max(1, r["n"])))])
    # of other languages there is no share, so none is drawn
    drawn = teaches.where(F.col("o") < share[F.col("lang")] * F.lit(float(2**62)))
    drawn = drawn.select("lang", "o", F.substring("text", F.col("at") + 1, F.lit(MAX_TRAIN_CHARS)).alias("text")).dropDuplicates(["lang", "o"])
    taken: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        taken.setdefault(r["lang"], []).append((r["o"], r["text"]))
    chosen = [(lang, text) for lang in sorted(taken) for _, text in sorted(taken[lang])[:rows]]
    return fit([t for _, t in chosen], [x for x, _ in chosen])


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(StructType().add("lang_pred", "string").add("score", "double"))
    def label(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    (held,) = unused(docs.columns, "label")
    return docs.withColumn(held, label(F.col(text_col))).withColumns({"lang_pred": F.col(f"{held}.lang_pred"), "score": F.col(f"{held}.score")}).drop(held)


def langid_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "lang_pred", "score")
