"""Tokens of two tokenizers aligned by the bytes at which they end: an event sweep.

Every token is an event at the byte offset of its end.  ``token_events`` gives
the events of both sides, A and B, of every document in one pass; an event row
holds a run of one side's events, packed, from the offset ``start`` on.  The
runs are repartitioned by document and sorted by offset within partitions, and
a machine reads them as they come.  It keeps, for the document at hand, only
the events since the last offset at which both sides end: there a group closes,
and the two tokens that end there are linked.  Sums and a running hash are all
that it carries over.

Two tokens that end together are such that the bytes of one end with the bytes
of the other, so the id pairs that can ever be linked are listed from the two
vocabularies: fewer than the bytes of all their tokens together.  Corpus-wide
counts are one array over that list, whatever the corpus.

Encoding.  Both tokenizers are blind across a single blank between two
characters that are not white space: A's pattern begins a word there, and no
piece of B's has its mark for a blank behind another character.  (The second is
looked up in the model, else texts are encoded whole.)  So texts are cut there
and every distinct cut is encoded once while it is remembered.

Cases.  Texts that are null or empty, or that B does not spell byte for byte
(those with U+2581), have no tokens: zeros, an empty hash.  Ids may be null or
repeated: each row is a document of its own.  Texts of any length are encoded
whole and pass through the machine in runs.  An empty table gives none.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage
from .tokens import _byte_letters

A, B, NOTHING = 0, 1, 2
#: Bytes of text in a run of events, and links in a row of the machine's output.
RUN_BYTES, ROW_LINKS = 1 << 18, 1 << 20
#: Cuts remembered by a task, and the longest that is.
MEMORY, LONGEST = 300_000, 48
_CUT = re.compile(r" (?<=\S )(?=\S)")

EVENTS = "key long, doc_id long, start long, side int, ids binary"
SWEPT = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, groups string"


class Vocabularies:
    """Both tokenizers and what their tokens spell; made once in each worker."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        import tiktoken

        spec, letters = json.loads(byte_level)["model"], _byte_letters()
        special = {t["id"] for t in json.loads(byte_level)["added_tokens"]}
        spelt = {i: bytes(letters[c] for c in t) for t, i in spec["vocab"].items() if i not in special}
        self.a_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        ranks = [spec["vocab"]["".join(m)] for m in merges]
        if ranks != sorted(ranks):  # then the order of ids is not the order of merges
            raise ValueError("the byte-level vocabulary must list its tokens in the order of their merges")
        # the pattern of byte-level pre-tokenization, a fixed value
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={s: i for i, s in spelt.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in named)
        self.held: dict[str, tuple[bytes, bytes, bool]] = {}

    def _encode(self, cuts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Packed ids of A and B, and whether B spells the cut, of each blank + cut."""
        out = []
        for cut, b in zip(cuts, self.b.encode(cuts, num_threads=1), strict=True):
            a = np.array(self.a.encode_ordinary(f" {cut}"), "<u2")
            out.append((a.tobytes(), np.array(b, "<u2").tobytes(), b"".join(map(self.b_bytes.__getitem__, b)) == f" {cut}".encode()))
        return out

    def runs(self, text: str) -> Iterator[tuple[int, bytes, bytes]] | None:
        """(first byte, A's ids, B's ids) of stretches of blank + text; None if B does not spell it."""
        cuts = _CUT.split(text) if self.cuts else [text]
        new = [c for c in dict.fromkeys(cuts) if c not in self.held]
        lone: dict[str, tuple[bytes, bytes, bool]] = {}
        if new:
            if len(self.held) > MEMORY:
                self.held.clear()
                new = list(dict.fromkeys(cuts))
            for cut, both in zip(new, self._encode(new), strict=True):
                (self.held if len(cut) <= LONGEST else lone)[cut] = both
        met = [self.held.get(c) or lone[c] for c in cuts]
        if not all(m[2] for m in met):
            return None
        return self._stretches(cuts, met)

    @staticmethod
    def _stretches(cuts: list[str], met: list[tuple[bytes, bytes, bool]]) -> Iterator[tuple[int, bytes, bytes]]:
        # each cut and the blank before it
        ends = np.cumsum([len(c.encode()) + 1 for c in cuts])
        first, start = 0, 0
        while first < len(cuts):
            last = max(first + 1, int(np.searchsorted(ends, start + RUN_BYTES)))
            yield start, b"".join(m[0] for m in met[first:last]), b"".join(m[1] for m in met[first:last])
            first, start = last, int(ends[last - 1])


def linkable(v: Vocabularies) -> np.ndarray:
    """The sorted pairs a << 16 | b of tokens of which one ends with the other's bytes."""
    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    spelt_a, spelt_b = by_bytes(v.a_bytes), by_bytes(v.b_bytes)
    found = {a << 16 | b for s, ids in spelt_a.items() for k in range(len(s)) for b in spelt_b.get(s[k:], ()) for a in ids}
    found |= {a << 16 | b for s, ids in spelt_b.items() for k in range(len(s)) for a in spelt_a.get(s[k:], ()) for b in ids}
    return np.array(sorted(found), np.int64)


_MADE: dict[int, Vocabularies] = {}


def _vocabularies(shared) -> Vocabularies:
    files = shared.value
    key = hash(files)
    if key not in _MADE:
        _MADE[key] = Vocabularies(*files)
    return _MADE[key]


def token_events(docs: DataFrame, shared) -> DataFrame:
    """The events of both sides of ``docs`` (doc_id, text): one row for a run of a side, one without events for a document without tokens."""
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabularies(shared)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                runs = v.runs(text) if text else None
                if runs is None:
                    rows.append((key, doc_id, 0, NOTHING, b""))
                    continue
                for start, a, b in runs:
                    rows += [(key, doc_id, start, A, a), (key, doc_id, start, B, b)]
                    held += len(a) + len(b)
                    if held > 1 << 22:
                        yield _batch(rows, EVENT_TYPES)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, EVENT_TYPES)

    # the number of a row in its task names a document; both sides come from one pass, so they agree on it
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, EVENTS)


EVENT_TYPES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])
SWEPT_TYPES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("groups", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Machine:
    """Reads the runs of one document in the order of their offsets."""

    def __init__(self, tables: Tables, keep_groups: bool):
        self.tables, self.keep = tables, keep_groups
        self.open = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in (A, B)]
        self.hash, self.tokens, self.n_groups = hashlib.sha256(), [0, 0], 0
        self.links: list[np.ndarray] = []
        self.text: list[bytes] = []
        self.held = 0

    def read(self, side: int, start: int, ids: np.ndarray) -> None:
        was, ends = self.open[side]
        self.open[side] = (np.concatenate([was, ids]), np.concatenate([ends, start + np.cumsum(self.tables.widths[side][ids])]))
        self.tokens[side] += len(ids)
        if len(self.open[A][0]) and len(self.open[B][0]):
            self._close()

    def _close(self) -> None:
        """Closes the groups whose last offset both sides have reached."""
        (a, a_ends), (b, b_ends) = self.open
        at = np.searchsorted(b_ends, a_ends)
        last_a = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends)
        if not len(last_a):
            return
        last_b = at[last_a]
        n_a, n_b = last_a[-1] + 1, last_b[-1] + 1
        self.links.append(np.searchsorted(self.tables.pairs, a[last_a] << 16 | b[last_b]).astype("<i4"))
        self.held += len(last_a)
        self.n_groups += len(last_a)
        # A's tokens of a group, then B's; what follows a token tells what ends with it
        out = np.empty(n_a + n_b, np.int64)
        closes_a, closes_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        closes_a[last_a] = closes_b[last_b] = 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out[np.arange(n_a) + np.concatenate([[0], last_b + 1])[group_a]] = 3 * a[:n_a] + closes_a
        out[np.arange(n_b) + last_a[group_b] + 1] = 3 * b[:n_b] + 2 * closes_b
        said = b"".join(map(self.tables.said.__getitem__, out.tolist()))[:-1]
        if self.n_groups > len(last_a):
            said = b";" + said
        self.hash.update(said)
        if self.keep:
            self.text.append(said)
        self.open = [(a[n_a:], a_ends[n_a:]), (b[n_b:], b_ends[n_b:])]

    def row(self, key: int, doc_id: int | None, last: bool) -> tuple:
        """What has gathered since the last row; with the last one, the counts and the hash."""
        links = np.concatenate(self.links).tobytes() if self.links else b""
        text = b"".join(self.text).decode() if self.keep else None
        self.links, self.text, self.held = [], [], 0
        if not last:
            return key, doc_id, 0, 0, 0, len(links) // 4, None, links, text
        return key, doc_id, *self.tokens, self.n_groups, len(links) // 4, self.hash.hexdigest() if self.tokens[A] else "", links, text


class Tables:
    """What the machine looks up: bytes of each token, linkable pairs, ids as they are written."""

    def __init__(self, v: Vocabularies):
        self.widths = [np.array([len(t) for t in tokens], np.int64) for tokens in (v.a_bytes, v.b_bytes)]
        self.pairs = linkable(v)
        self.said = [b"%d%c" % (i, sep) for i in range(max(map(len, self.widths))) for sep in b",|;"]


def sweep(events: DataFrame, shared, keep_groups: bool = False) -> DataFrame:
    """Groups and links of each document; ``links`` are indices into the linkable pairs, ``groups`` (on demand) the written groups.

    A document with many links has several rows; its last one holds the counts.
    """
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, now, machine, rows, held = Tables(_vocabularies(shared)), None, None, [], 0
        for batch in batches:
            for key, doc_id, start, side, ids in zip(*(batch.column(c).to_pylist() for c in EVENT_TYPES.names), strict=True):
                if now is None or key != now[0]:
                    if now:
                        held += 4 * machine.held
                        rows.append(machine.row(*now, True))
                    now, machine = (key, doc_id), Machine(tables, keep_groups)
                if side != NOTHING:
                    machine.read(side, start, np.frombuffer(ids, "<u2").astype(np.int64))
                if machine.held >= ROW_LINKS:
                    held += 4 * machine.held
                    rows.append(machine.row(*now, False))
                if held > 1 << 22 or len(rows) > 10_000:
                    yield _batch(rows, SWEPT_TYPES)
                    rows, held = [], 0
        if now:
            rows.append(machine.row(*now, True))
            yield _batch(rows, SWEPT_TYPES)

    by_document = events.repartition("key").sortWithinPartitions("key", "start", "side")
    return by_document.mapInArrow(read, SWEPT)


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch's rows one after another, and how many each row has."""
    parts = batch.column("links").to_pylist()
    return np.frombuffer(b"".join(parts), "<i4"), np.array([len(p) // 4 for p in parts], np.int64)


def pair_counts(swept: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the corpus hold each linkable pair; each task sends its own sums."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch)[0], minlength=n_pairs)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    sums = swept.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out, met = np.zeros(n_pairs, np.int64), sums.toArrow()  # at most the linkable pairs
    out[met["pair"].to_numpy()] = met["n"].to_numpy()
    return out


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its B id."""
    b = pairs & 0xFFFF
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, b, counts)
    return counts == most[b]


def align(docs: DataFrame, byte_level_path: str, pieces_path: str) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The vocabulary files' contents are sent to the executors; the swept documents are written once.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
        files = a.read(), b.read()
    shared = context.broadcast(files)
    swept = stage(sweep(token_events(docs, shared), shared).drop("groups"), "swept-tokens")
    pairs = linkable(Vocabularies(*files))
    counts = pair_counts(swept, len(pairs))
    told = context.broadcast((counts, best_pairs(pairs, counts)))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = told.value
        for batch in batches:
            links, sizes = _joined(batch)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)])[ends] for x in (best, count)]
            held = {c: batch.column(c) for c in batch.schema.names if c != "links"}
            yield pa.RecordBatch.from_pydict(held | {"n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1])})

    kept = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    weighed = swept.mapInArrow(weigh, f"{kept}, n_best long, count_sum long")
    total = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return weighed.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *total, F.max("groups_sha256").alias("groups_sha256")).drop("key")
