"""Toxicity scores from a convolutional text classifier trained in numpy.

Words are hashed into ``BUCKETS`` embeddings, each word being the sum of its own
and that of its first ``PREFIX`` bytes, so inflected forms share a part.  The
embeddings start from the words' log-odds between the classes.  Filters of
several widths run over the words of the whole text, max pooling keeps each
filter's strongest window, and a logistic layer gives a logit.  A threshold per
language is subtracted before the sigmoid, so 0.5 is the decision everywhere.
Thresholds are calibrated by cross-fitting at every size: each labelled row's
logit comes from weights that were fitted without its part of ``PARTS``; the
final weights are fitted on all parts.  The language is guessed from the
text itself by word frequencies of the fitting rows; the columns ``lang``,
``source``, ``doc_id`` and the labels are never inputs of a score.

Every labelled row outside the held-out fold teaches, with its whole text: word
counts are sums over all of them, thresholds come from the logits of all of them,
and the weights are fitted by parameter averaging.  Rows are dealt by hash to
workers of about ``WORKER_WORDS`` words; in each round every worker walks all its
rows from the common weights, and what the workers moved is averaged (a word's
embedding over the workers that moved it).  A worker's steps are few, so small
tables, which are one worker, are walked several times.  Sums are of integers, so
the weights do not depend on how Spark deals tasks.  Texts without a label are
not shuffled.  The driver holds word counts and the rows of the weights that
moved; the tasks make the first weights from the counts.  Rows with a null label, text
or id do not teach; an id with several labels counts as toxic if one says so.
Languages beyond the ``MAX_LANGS`` most frequent share one threshold.  Null and
empty texts get the score of a text without words.  Without both classes among
the labels every score is 0.  Repeated rows get equal scores.  Other columns pass
through, but for ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import wordhash
from .base import discard, drop_finished, held_out, stage

BUCKETS = 1 << 17
WIDTHS = (1, 2, 3)
FILTERS, DIMS = 8, 12
#: Windows of a batch that are worked on together while fitting; longer batches and texts go on block by block.
MAX_TRAIN_CHARS = 30_000
PREFIX = 4
#: Steps that a worker takes at least, where its rows are few, unless it would walk ``WALKED`` words.
STEPS, BATCH = 250, 48
WORKER_WORDS, WALKED = 4_000_000, 16_000_000
#: Rounds of averaging where there is more than one worker.
ROUNDS = 2
MAX_LANGS = 32
#: Logits are counted in cells of 1 / ``GRID``, up to ``FAR`` from 0.
GRID, FAR = 256, 32
#: What is averaged is summed in units of 1 / ``UNIT``.
UNIT = 1 << 24
#: Counts and averages reach the driver in rows of this many buckets.
BLOCK = 1 << 13
#: Bits of the filter that spares unlabelled texts the join; more than one id may share a bit.
MARKS = 1 << 25
FOLDS, HELD = 5, 0
PARTS = 3
#: Texts that are taken together outside the steps of fitting.
TOGETHER = 32
_PAD = BUCKETS


def word_ids(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word, each text followed by padding; where texts begin; and where their last windows begin, exclusive."""
    gap = max(WIDTHS) - 1
    room = np.maximum(counts, 1) + gap
    begins = np.concatenate([[0], np.cumsum(room)[:-1]])
    ids = np.full((int(room.sum()) + gap, 2), _PAD, np.int32)
    place = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(hashes))
    ids[place] = hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return ids, begins, begins + np.maximum(counts, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Classifier:
    embed: np.ndarray
    kernels: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    word_logp: np.ndarray
    thresholds: np.ndarray
    constant: bool = False
    _made: dict = field(default_factory=dict, repr=False)

    def _projected(self) -> dict[int, list[np.ndarray]]:
        """Filter taps applied to every embedding once, so scoring only adds rows."""
        if not self._made:
            self._made.update({w: [(self.embed @ self.kernels[w][k]).astype(np.float32) for k in range(w)] for w in WIDTHS})
        return self._made

    def logits(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each text, from the windows that begin in it: none sees the next text."""
        n = len(ids) - max(WIDTHS) + 1
        pooled = []
        for w, taps in self._projected().items():
            z = taps[0][ids[:n, 0]]
            z += taps[0][ids[:n, 1]]
            for k in range(1, w):
                z += taps[k][ids[k : n + k, 0]]
                z += taps[k][ids[k : n + k, 1]]
            best = np.maximum.reduceat(z, np.stack([begins, ends], axis=1).reshape(-1), axis=0)[::2]
            pooled.append(np.maximum(best + self.bias[w], 0))
        # summed row by row, so a text's score does not depend on its neighbours
        return (np.concatenate(pooled, axis=1) * self.out).sum(axis=1) + self.out_bias

    def languages(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.word_logp[ids[:, 0]], begins, axis=0).argmax(axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.constant:
            return out
        for first, end, hashes, counts in wordhash.slices(texts, wordhash.BY_LETTER, PREFIX):
            ids, begins, ends = word_ids(hashes, counts)
            out[first:end] = _sigmoid(self.logits(ids, begins, ends) - self.thresholds[self.languages(ids, begins)])
        return out


def _adam(params: list[np.ndarray], grads: list[np.ndarray], memory: list, step: int, rate: float) -> None:
    for i, (p, g) in enumerate(zip(params, grads, strict=True)):
        m, v = memory[i]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def fit(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 5) -> Classifier:
    """Fit on word-hash arrays of texts."""
    return fit_buckets([_own_ids(h) for h in docs], labels, langs, seed)


def _own_ids(hashes: np.ndarray) -> np.ndarray:
    """As ``word_ids``, of one text and with the padding behind it only."""
    return word_ids(hashes, np.array([len(hashes)]))[0][: max(1, len(hashes)) + max(WIDTHS) - 1]


def fit_buckets(flat: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 5) -> Classifier:
    """Fit on the padded word buckets of texts, as one worker; ``train`` does the same over a table."""
    if len(set(labels.tolist())) < 2:
        return _constant()
    names = sorted({x for x in langs if x}) or [""]
    # parts with equal shares of both classes
    part, rng = np.zeros(len(flat), np.int64), np.random.default_rng(seed)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == label))
        part[own] = np.arange(len(own)) % PARTS
    logits = np.zeros(len(flat))
    for k in range(PARTS):
        fitting, rest = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(rest) and len(set(labels[fitting].tolist())) == 2:
            logits[rest] = _logits(_weights(flat, labels, langs, names, fitting, seed), flat, rest)
    model = _weights(flat, labels, langs, names, np.arange(len(flat)), seed)
    guess = np.concatenate([model.languages(*_joined(flat, some)[:2]) for some in np.array_split(np.arange(len(flat)), -(-len(flat) // TOGETHER))])
    model.thresholds[:] = _thresholds(guess, _cells(logits), labels, np.ones(len(flat), np.int64), len(names))
    return model


def _constant() -> Classifier:
    zero = np.zeros((BUCKETS + 1, 1), np.float32)
    return Classifier(zero, {}, {}, np.zeros(0), 0.0, zero, np.zeros(1), constant=True)


def _joined(flat: list[np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_ids``, of some texts."""
    ids = np.concatenate([flat[i] for i in some] + [np.full((max(WIDTHS) - 1, 2), _PAD, np.int32)])
    room = np.array([len(flat[i]) for i in some])
    begins = np.concatenate([[0], np.cumsum(room)[:-1]])
    return ids, begins, begins + room - (max(WIDTHS) - 1)


def _logits(model: Classifier, flat: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    return np.concatenate([model.logits(*_joined(flat, part)) for part in np.array_split(some, -(-len(some) // TOGETHER))])


def _weights(flat: list[np.ndarray], labels: np.ndarray, langs: list[str | None], names: list[str], fitting: np.ndarray, seed: int) -> Classifier:
    """Weights fitted on the rows ``fitting``; thresholds 0."""
    seen, by_lang = np.zeros((2, BUCKETS + 1)), np.zeros((len(names), BUCKETS + 1))
    for i in fitting:
        _count(flat[i], seen[labels[i]], by_lang[names.index(langs[i])] if langs[i] else None)
    n = np.bincount(labels[fitting], minlength=2)
    model = _start(seen, n, by_lang, seed)
    epochs = _epochs(len(fitting), sum(len(flat[i]) for i in fitting), 1)
    _walk(model, [flat[i] for i in fitting], labels[fitting], n.sum() / (2 * n), epochs, [seed, 0, 0], 0.0, 1.0)
    return model


def _count(own: np.ndarray, seen: np.ndarray, by_lang: np.ndarray | None) -> None:
    """Add a text to the counts of texts by bucket, and of words by bucket in its language."""
    seen[np.unique(own)] += 1
    if by_lang is not None:
        np.add.at(by_lang, own[:, 0], 1)


def _epochs(rows: float, words: float, rounds: int) -> int:
    """How often a worker walks its rows in a round."""
    return max(1, int(min(STEPS * BATCH / max(rows, 1), WALKED / max(words, 1)) / rounds))


def _start(seen: np.ndarray, n: np.ndarray, by_lang: np.ndarray, seed: int) -> Classifier:
    """First weights, the embeddings from counts of all texts by class; and the word frequencies by language."""
    rng = np.random.default_rng(seed)
    word_logp = np.empty((BUCKETS + 1, len(by_lang)), np.float32)
    for k, own in enumerate(by_lang):
        freq = own + 0.1
        freq[_PAD] = 1
        word_logp[:, k] = np.log(freq / freq.sum())
    word_logp[_PAD] = 0
    odds = np.log((seen[1] + 0.2) / (n[1] + 0.4)) - np.log((seen[0] + 0.2) / (n[0] + 0.4))
    odds *= seen.sum(axis=0) / (seen.sum(axis=0) + 2)

    embed = rng.normal(0, 0.05, (BUCKETS + 1, DIMS)).astype(np.float32)
    embed[:, 0] += 0.5 * odds
    embed[_PAD] = 0
    kernels = {w: rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        kernels[w][0, 0, : FILTERS // 2] = 1.0
    bias = {w: np.full(FILTERS, -0.2, np.float32) for w in WIDTHS}
    out = rng.normal(0.2, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    return Classifier(embed, kernels, bias, out, -1.0, word_logp, np.zeros(len(by_lang)))


def _strongest(model: Classifier, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each width, each text's and filter's strongest window: where it begins, and its value."""
    best = {w: (np.zeros((len(begins), FILTERS), np.int64), np.full((len(begins), FILTERS), -np.inf, np.float32)) for w in WIDTHS}
    n = len(ids) - max(WIDTHS) + 1
    for low in range(0, n, MAX_TRAIN_CHARS):
        high = min(n, low + MAX_TRAIN_CHARS)
        near = ids[low : high + max(WIDTHS) - 1]
        words = model.embed[near[:, 0]] + model.embed[near[:, 1]]
        some = range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(begins, high)))
        for w, (top, value) in best.items():
            z = sum(words[k : high - low + k] @ model.kernels[w][k] for k in range(w))
            for d in some:
                first, end = max(begins[d], low), min(ends[d], high)
                at = z[first - low : end - low].argmax(axis=0)
                now = z[first - low + at, np.arange(FILTERS)]
                higher = now > value[d]
                top[d][higher], value[d][higher] = (first + at)[higher], now[higher]
    return best


def _walk(model: Classifier, flat: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int, seed: list[int], begun: float, done: float) -> np.ndarray:
    """Walk all texts ``epochs`` times in steps of ``BATCH``; both classes are spread evenly and weigh ``weight``.

    ``begun`` and ``done`` are the shares of the whole fit before and after; they set the rate.
    Changes the model in place and tells which embeddings moved.
    """
    rng = np.random.default_rng(seed)
    out_bias = np.array([model.out_bias], np.float32)
    embed, kernels, bias, out = model.embed, model.kernels, model.bias, model.out
    params = [*kernels.values(), *bias.values(), out, out_bias]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rows_memory = (np.zeros_like(embed), np.zeros_like(embed))
    moved = np.zeros(len(embed), bool)

    step, steps = 0, epochs * -(-len(flat) // BATCH)
    for _ in range(epochs):
        classes = [rng.permutation(np.flatnonzero(labels == label)) for label in (0, 1)]
        even = np.concatenate([(np.arange(len(own)) + 0.5) / max(1, len(own)) for own in classes])
        order = np.concatenate(classes)[np.argsort(even, kind="stable")]
        for at in range(0, len(order), BATCH):
            step += 1
            pick = order[at : at + BATCH]
            y = labels[pick].astype(np.float32)
            ids, begins, ends = _joined(flat, pick)
            best = _strongest(model, ids, begins, ends)
            x = np.concatenate([best[w][1] + bias[w] for w in WIDTHS], axis=1)
            grads = [np.zeros_like(p) for p in params]
            hidden = np.maximum(x, 0)
            drop = (rng.random(hidden.shape) < 0.8) / 0.8
            p = _sigmoid((hidden * drop) @ out + out_bias[0])
            g = (p - y) * weight[labels[pick]] / len(pick)
            grads[-1][0], grads[-2][:] = g.sum(), (hidden * drop).T @ g + 1e-4 * out
            gx = np.outer(g, out) * drop * (x > 0)
            where, moves = [], []
            for j, w in enumerate(WIDTHS):
                part = gx[:, j * FILTERS : (j + 1) * FILTERS]
                grads[len(WIDTHS) + j][:] = part.sum(axis=0)
                for k in range(w):
                    own = ids[best[w][0] + k]
                    grads[j][k] += np.einsum("bfd,bf->df", embed[own].sum(axis=2), part)
                    move = (part[:, :, None] * kernels[w][k].T[None]).reshape(-1, DIMS)
                    for column in (0, 1):
                        where.append(own[:, :, column].reshape(-1))
                        moves.append(move)
            rate = 0.02 * (1 - begun - (done - begun) * step / (steps + 1))
            rows, place = np.unique(np.concatenate(where), return_inverse=True)
            row_grads = np.zeros((len(rows), DIMS), np.float32)
            np.add.at(row_grads, place, np.concatenate(moves))
            row_grads[rows == _PAD] = 0
            held = (rows_memory[0][rows], rows_memory[1][rows])
            changed = embed[rows]
            _adam([changed], [row_grads], [held], step, rate)
            embed[rows], rows_memory[0][rows], rows_memory[1][rows] = changed, *held
            moved[rows] = True
            _adam(params, grads, memory, step, rate)
            model.out_bias = float(out_bias[0])
    return moved


def _cells(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logits * GRID), -FAR * GRID, FAR * GRID).astype(np.int64)


def _threshold(cells: np.ndarray, ones: np.ndarray, zeros: np.ndarray, default: float = 0.0) -> float:
    """The cut with the fewest balanced errors, in the middle of the widest best gap; counts by ascending cell."""
    if not (ones.sum() and zeros.sum()):
        return default
    x = cells / GRID
    miss = np.concatenate([[0], np.cumsum(ones)]) / ones.sum()
    false = (zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])) / zeros.sum()
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    width = np.concatenate([[0], np.diff(x), [0]])
    cost = miss + false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(edges[best[width[best].argmax()]])


def _thresholds(guess: np.ndarray, cells: np.ndarray, labels: np.ndarray, n: np.ndarray, langs: int) -> np.ndarray:
    """Of each guessed language, drawn to the common one where it has few rows; from counts by guess, cell and label."""

    def cut(own: np.ndarray, default: float = 0.0) -> tuple[float, int]:
        x, at = np.unique(cells[own], return_inverse=True)
        ones, zeros = (np.bincount(at, n[own] * (labels[own] == label), len(x)) for label in (1, 0))
        return _threshold(x, ones, zeros, default), min(ones.sum(), zeros.sum())

    common, _ = cut(np.ones(len(cells), bool))
    out = np.full(langs, common)
    for k in range(langs):
        own, enough = cut(guess == k, common)
        weight = enough / (enough + 20)
        out[k] = weight * own + (1 - weight) * common
    return out


def _packed(model: Classifier) -> np.ndarray:
    """All weights as rows of ``DIMS``, the embeddings first."""
    rest = np.concatenate([*(k.reshape(-1) for k in model.kernels.values()), *model.bias.values(), model.out, [model.out_bias]]).astype(np.float32)
    return np.concatenate([model.embed, np.pad(rest, (0, -len(rest) % DIMS)).reshape(-1, DIMS)])


def _unpacked(weights: np.ndarray, word_logp: np.ndarray, langs: int) -> Classifier:
    """The inverse of ``_packed``; shares nothing with ``weights``."""
    rest, kernels, bias, at = weights[BUCKETS + 1 :].reshape(-1), {}, {}, 0
    for w in WIDTHS:
        kernels[w] = rest[at : at + w * DIMS * FILTERS].reshape(w, DIMS, FILTERS).copy()
        at += w * DIMS * FILTERS
    for w in WIDTHS:
        bias[w] = rest[at : at + FILTERS].copy()
        at += FILTERS
    out = rest[at : at + FILTERS * len(WIDTHS)].copy()
    return Classifier(weights[: BUCKETS + 1].copy(), kernels, bias, out, float(rest[at + len(out)]), word_logp, np.zeros(langs))


def _texts(texts: pd.Series) -> Iterator[np.ndarray]:
    """The padded word buckets of each text."""
    for _, _, words, counts in wordhash.slices(texts.tolist(), wordhash.BY_LETTER, PREFIX):
        for own in np.split(words, np.cumsum(counts)[:-1]):
            yield _own_ids(own)


def _labelled(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """The rows whose ids have a mark of ``taught``: all labelled ones and, by shared marks, few others."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    marks = taught.select(mark.alias("mark")).groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits"))
    at = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("bucket", F.bitmap_bucket_number(mark)).join(F.broadcast(marks), "bucket")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(docs.columns)


def _counted(rows: DataFrame, langs: dict[str, int], pooled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Texts by part, class and bucket; texts by part and class; words by language and bucket; words. Of all rows."""
    kinds = 2 * PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # two columns more: texts and words
        own = np.zeros((kinds + len(langs) + pooled, BUCKETS + 3), np.int64)
        for batch in batches:
            for ids, part, label, lang in zip(_texts(batch["text"]), batch["part"], batch["toxic"], batch["lang"], strict=True):
                kind = 2 * part + label
                by_lang = own[kinds + langs.get(lang, len(langs))] if lang else None
                _count(ids, own[kind, : BUCKETS + 1], by_lang)
                own[kind, BUCKETS + 1 :] += 1, len(ids)
        kind, bucket = own.nonzero()
        yield pd.DataFrame({"kind": kind, "bucket": bucket, "n": own[kind, bucket]})

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [key[0]], "at": [group["bucket"].to_numpy(np.int32).tobytes()], "n": [group["n"].to_numpy(np.int64).tobytes()]})

    summed = rows.select("text", "lang", "part", "toxic").mapInPandas(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    by_class, by_lang = np.zeros((kinds, BUCKETS + 3), np.int64), np.zeros((max(1, len(langs) + pooled), BUCKETS + 3), np.int64)
    for r in summed.groupBy("kind", _block("bucket")).applyInPandas(joined, "kind int, at binary, n binary").collect():
        own = by_class[r["kind"]] if r["kind"] < kinds else by_lang[r["kind"] - kinds]
        own[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    by_class = by_class.reshape(PARTS, 2, -1)
    return by_class[:, :, : BUCKETS + 1], by_class[:, :, BUCKETS + 1], by_lang[:, : BUCKETS + 1], int(by_class[:, :, BUCKETS + 2].sum())


def _block(at: str) -> Column:
    return F.shiftright(at, BLOCK.bit_length() - 1).alias("block")


@dataclass
class _Fits:
    """The fits without a part, and that on all: counts by part and class, and of each fit the weights that moved."""

    seen: np.ndarray
    n: np.ndarray
    seed: int
    moved: list[tuple[np.ndarray, np.ndarray] | None] = field(default_factory=lambda: [None] * (PARTS + 1))

    def sizes(self, k: int) -> np.ndarray:
        """Texts of each class."""
        return self.n[np.arange(PARTS) != k].sum(axis=0)

    def weights(self, k: int) -> np.ndarray | None:
        """Packed; nothing without both classes."""
        if not self.sizes(k).all():
            return None
        out = _packed(_start(self.seen[np.arange(PARTS) != k].sum(axis=0), self.sizes(k), np.zeros((0, BUCKETS + 1)), self.seed))
        if self.moved[k] is not None:
            at, change = self.moved[k]
            out[at] += change
        return out

    def move(self, k: int, at: np.ndarray, change: np.ndarray) -> None:
        if self.moved[k] is not None:
            at, change = np.concatenate([self.moved[k][0], at]), np.concatenate([self.moved[k][1], change])
        rows, place = np.unique(at, return_inverse=True)
        out = np.zeros((len(rows), DIMS), np.float32)
        np.add.at(out, place, change)
        self.moved[k] = rows, out


def _round(rows: DataFrame, fits: _Fits, workers: int, epochs: int, seed: list[int], begun: float, done: float) -> None:
    """Each worker walks its rows from the common weights, for each of the fits; what they moved is averaged."""
    at_first = rows.sparkSession.sparkContext.broadcast(fits)
    columns = [f"d{i}" for i in range(DIMS)]

    def teach(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id"], kind="stable")
        part, labels = group["part"].to_numpy(), group["toxic"].to_numpy(np.int64)
        flat = list(_texts(group["text"]))
        out = []
        for k in range(PARTS + 1):
            own, before = np.flatnonzero(part != k), at_first.value.weights(k)
            if before is None or not len(own):
                continue
            model, n = _unpacked(before, np.zeros((0, 0)), 0), at_first.value.sizes(k)
            moved = _walk(model, [flat[i] for i in own], labels[own], n.sum() / (2 * n), epochs, [*seed, int(key[0])], begun, done)
            after = _packed(model)
            at = np.concatenate([np.flatnonzero(moved), np.arange(len(moved), len(after))])
            frame = pd.DataFrame(np.rint((after[at].astype(float) - before[at]) * UNIT).astype(np.int64), columns=columns)
            out.append(frame.assign(fit=k, at=at))
        return pd.concat(out) if out else pd.DataFrame(columns=[*columns, "fit", "at"])

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": [key[0]], "at": [group["at"].to_numpy(np.int32).tobytes()], "change": [group[columns].to_numpy(np.float32).tobytes()]})

    means = (
        rows.select("doc_id", "text", "place", "part", "toxic").groupBy(F.pmod("place", F.lit(workers)).alias("worker"))
        .applyInPandas(teach, ", ".join(f"{c} long" for c in columns) + ", fit int, at int")
        .groupBy("fit", "at").agg(*((F.sum(c) / (F.count(F.lit(1)) * UNIT)).cast("float").alias(c) for c in columns))
    )
    got = means.groupBy("fit", _block("at")).applyInPandas(joined, "fit int, at binary, change binary").collect()
    for k in range(PARTS + 1):
        if own := [r for r in got if r["fit"] == k]:
            at, change = (b"".join(r[c] for r in own) for c in ("at", "change"))
            fits.move(k, np.frombuffer(at, np.int32), np.frombuffer(change, np.float32).reshape(-1, DIMS))
    at_first.destroy()


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Classifier:
    """Fit on all labelled rows outside the held-out fold."""
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, HELD))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    rows = stage(
        _labelled(docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang"), taught).join(taught.hint("merge"), "doc_id").select(
            "doc_id", "text", "lang", "toxic", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PARTS)).cast("int").alias("part"), F.xxhash64("doc_id", "text").alias("place")
        ),
        "taught",
    )
    try:
        return _trained(rows, seed)
    finally:
        discard(rows)


def _trained(rows: DataFrame, seed: int) -> Classifier:
    spark = rows.sparkSession
    spoken = rows.where(F.length("lang") > 0).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()
    langs = {lang: k for k, lang in enumerate(sorted(r["lang"] for r in spoken[:MAX_LANGS]))}
    drop_finished(spark)
    seen, n, by_lang, words = _counted(rows, langs, int(len(spoken) > MAX_LANGS))
    if not n.sum(axis=0).all():
        return _constant()
    fits, names = _Fits(seen, n, seed), len(by_lang)
    word_logp = _start(seen.sum(axis=0), fits.sizes(PARTS), by_lang, seed).word_logp
    del by_lang
    workers = -(-words // WORKER_WORDS)
    rounds = ROUNDS if workers > 1 else 1
    epochs = _epochs(n.sum() / workers, words / workers, rounds)
    for k in range(rounds):
        drop_finished(spark)
        _round(rows, fits, workers, epochs, [seed, k], k / rounds, (k + 1) / rounds)

    drop_finished(spark)
    last = spark.sparkContext.broadcast((fits, word_logp))

    @F.pandas_udf("guess int, cell int")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        models = [None if own is None else _unpacked(own, last.value[1], names) for own in map(last.value[0].weights, range(PARTS + 1))]
        for texts, part in batches:
            guess, logits = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for k, model in enumerate(models[:-1]):
                rest = np.flatnonzero(part.to_numpy() == k)
                for first, end, hashes, counts in wordhash.slices(texts.iloc[rest].tolist(), wordhash.BY_LETTER, PREFIX):
                    ids, begins, ends = word_ids(hashes, counts)
                    guess[rest[first:end]] = models[-1].languages(ids, begins)
                    if model is not None:
                        logits[rest[first:end]] = model.logits(ids, begins, ends)
            yield pd.DataFrame({"guess": guess, "cell": _cells(logits)})

    got = rows.select("toxic", judged("text", "part").alias("j")).groupBy("j.guess", "j.cell", "toxic").count().toPandas()
    last.destroy()
    model = _unpacked(fits.weights(PARTS), word_logp, names)
    model.thresholds[:] = _thresholds(*(got[c].to_numpy() for c in ("guess", "cell", "toxic", "count")), names)
    return model


def _score(docs: DataFrame, labels: DataFrame, text_col: str) -> Column:
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted``."""
    return docs.withColumn("score", _score(docs, labels, text_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the classifier does not reject; every column as it is, whatever its name."""
    return docs.where(_score(docs, labels, text_col) < 0.5)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs.select("doc_id", "text", "lang"), labels)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", "predicted")
