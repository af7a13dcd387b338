"""Repeated byte strings, by a distributed difference-cover suffix sort cut at a fixed length.

A byte is removed if it lies in a string of ``WINDOW`` bytes that also starts
earlier: in a smaller document, or at a smaller offset of the same one.

Which suffixes can share ``WINDOW`` bytes is found first, without loss.  Every
window has one anchor, the leftmost of its ``GRAM``-byte strings with the least
hash, which its content alone decides; so equal windows have equal anchors at
equal places.  Windows that follow each other mostly have one anchor: such a run
is one row.  Runs whose anchor occurs once in the corpus end here.  The others
fetch their bytes.  Equal runs are merged as they leave a task, and once more
where they meet; all but the earliest are removed as a whole.

What is left of an anchor, distinct runs that may share windows, is suffix sorted
in the task that the anchor's hash deals them to: positions whose distance from
the anchor is 1 or 2 modulo 3 are sampled; their names of 6 bytes are ranks in a
sort; triples of names are sorted and named anew (18, then 54 bytes, then two of
those: 99), the recursion on names; the remaining suffixes, at distance 0, are
merged in by their first byte and the name behind it; neighbours with equal
prefixes are equal windows, and all but the first are removed.  Names are ranks,
so this step compares bytes, not hashes.  Since equal windows lie alike about
their anchors, suffixes of different residues are never compared.

Anchors that occur ``HOT`` times and more are dealt further: their runs are cut
into stretches of 8 windows, and those meet by the 93 bytes that all windows of a
stretch share.

Cases.  Null and empty texts, and those shorter than a window, lose nothing.
Documents are ordered by id (nulls last), those of one id by a hash of their
text; rows that equal in both are one document, and each gets its result.
Texts of any length are scanned in slices.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stage
from .wordhash import mix

WINDOW, GRAM = 100, 24
#: Grams in a window.
SPREAD = WINDOW - GRAM + 1
#: Windows in a stretch of a hot anchor's run, and rows that make an anchor hot.
STRETCH, HOT = 8, 8_000
#: Bytes scanned at once, remembered by a task, and sorted at once.
SLICE, REMEMBERED, SORTED = 1 << 20, 1 << 25, 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9FB21C651E98DF25
_VALUES = np.random.default_rng(1973).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM``-byte string."""
    n = len(data)
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    up, down = _powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def _least(values: np.ndarray) -> np.ndarray:
    """The least of every ``SPREAD`` neighbours."""
    n = len(values)
    blocks = -(-n // SPREAD)
    padded = np.full(blocks * SPREAD, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, SPREAD)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - SPREAD + 1], ahead[SPREAD - 1 : n])


def anchored_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor's hash, anchor, first window, last window) of the texts that end at ``ends`` in ``data``, by place in ``data``."""
    if len(data) < WINDOW:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    hashes = _gram_hashes(data)
    anchor = (_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(anchor) + 1, np.int32)
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(window):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    own = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return hashes[own[first]], own[first], window[first], window[last]


def _slices(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, offset in the row's text) of texts taken together; a long text comes in slices that share windows' tails."""
    group: list[bytes] = []
    rows: list[int] = []
    held = 0

    def done():
        return np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(b) for b in group]), np.array(rows), np.zeros(len(rows), np.int64)

    for row, text in enumerate(texts):
        if not text or len(text) < WINDOW:
            continue
        if len(text) > SLICE:
            for at in range(0, len(text) - WINDOW + 1, SLICE):
                part = np.frombuffer(text, np.uint8, min(len(text) - at, SLICE + WINDOW - 1), at)
                yield part, np.array([len(part)]), np.array([row]), np.array([at])
            continue
        group.append(text)
        rows.append(row)
        held += len(text)
        if held > SLICE:
            yield done()
            group, rows, held = [], [], 0
    if group:
        yield done()


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, did, tid, text): ``did`` and ``tid`` name a document and order documents."""
    did: Column = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), did.alias("did"), F.xxhash64("text").alias("tid"), "text")


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, ends, rows, offsets in _slices(batch.column("bytes").to_pylist()):
            key, anchor, first, last = anchored_runs(data, ends)
            owner = np.searchsorted(ends, first, side="right")
            place = anchor - np.concatenate([[0], ends[:-1]])[owner] + offsets[owner]
            at = place << 16 | (anchor - first) << 8 | (last - first)
            row = pa.array(rows[owner])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column("did").take(row), batch.column("tid").take(row), pa.array(at)], names=["key", "did", "tid", "at"])


RUN = "content binary, shared_from int, shared int, did long, tid long, first long, last long"
_RUN = pa.schema([("content", pa.binary()), ("shared_from", pa.int32()), ("shared", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _pieces(anchor: int, first: int, last: int, hot: bool) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, start and length of the bytes by which they meet) of a run."""
    if not hot:
        yield first, last, anchor, GRAM
        return
    for k in range((anchor - last) // STRETCH * STRETCH, anchor - first + 1, STRETCH):
        yield max(first, anchor - k - STRETCH + 1), min(last, anchor - k), anchor - k, WINDOW - STRETCH + 1


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of marked runs, equal ones once as far as the task remembers; the later ones as runs without bytes, which are removed."""
    seen: dict[tuple[bytes, int, int], tuple[int, int, int, int]] = {}
    held, gone = 0, []

    def out() -> pa.RecordBatch:
        rows = [(content, at, size, *first) for (content, at, size), first in seen.items()] + [(None, 0, 0, *x) for x in gone]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)

    for batch in batches:
        for text, did, tid, marks in zip(*(batch.column(c).to_pylist() for c in ("bytes", "did", "tid", "marks")), strict=True):
            for mark in marks:
                at, hot = mark >> 1, mark & 1
                anchor = at >> 16
                first = anchor - (at >> 8 & 255)
                for lo, hi, start, size in _pieces(anchor, first, first + (at & 255), bool(hot)):
                    content = text[lo : hi + WINDOW]
                    key, here = (content, start - lo, size), (did, tid, lo, hi)
                    was = seen.get(key)
                    if was is None:
                        seen[key] = here
                        held += len(content)
                    elif here < was:
                        seen[key] = here
                        gone.append(was)
                    elif here > was:
                        gone.append(here)
            if held > REMEMBERED or len(gone) > 100_000:
                yield out()
                seen, held, gone = {}, 0, []
    if seen or gone:
        yield out()


def _ranked(*parts: np.ndarray) -> np.ndarray:
    """Names, by rank in a sort, of tuples of names (or of one array of any numbers)."""
    packed, bits = parts[0].astype(np.uint64), 21 if max(int(p.max(initial=0)) for p in parts[1:] or (parts[0][:0],)) < 1 << 21 else 32
    for k, p in enumerate(parts[1:]):
        if k and bits == 32:  # many names: two at a time
            packed = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
        packed = packed << np.uint64(bits) | p.astype(np.uint64)
    return np.unique(packed, return_inverse=True)[1]


def repeated_windows(contents: list[bytes], shared_from: list[int]) -> list[np.ndarray]:
    """Whether each window of each text equals one of an earlier text, by a difference-cover sort of prefixes.

    Equal windows must lie alike about the places ``shared_from``.
    """
    shift = [-s % 3 for s in shared_from]  # those places become multiples of 3
    sizes = np.array([len(c) + s for c, s in zip(contents, shift, strict=True)])
    sizes += -sizes % 3
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()) + 192, np.uint8)
    for content, at, by in zip(contents, starts, shift, strict=True):
        text[at + by : at + by + len(content)] = np.frombuffer(content, np.uint8)
    n = len(text) - 192
    sampled = np.arange(n + 96)
    sampled = sampled[sampled % 3 > 0]  # position i is at i // 3 * 2 + i % 3 - 1, so names at i + 3 k are 2 k further
    word = np.zeros(len(sampled), np.uint64)
    for k in range(6):
        word = word << np.uint64(8) | text[sampled + k].astype(np.uint64)
    name = _ranked(word)
    for reach, steps in ((18, (0, 6, 12)), (54, (0, 18, 36)), (99, (0, 45))):
        far = len(name) - 2 * steps[-1] // 3
        name = _ranked(*[name[2 * s // 3 : 2 * s // 3 + far] for s in steps])
    counts = np.array([len(c) - WINDOW + 1 for c in contents])
    owner = np.repeat(np.arange(len(contents)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (starts + shift)[owner] + within
    rest = at % 3 == 0
    # a sampled suffix is its name and the byte behind it, a remaining one its first byte and the name behind that
    named = np.where(rest, at + 1, at)
    full = name[named // 3 * 2 + named % 3 - 1] << 8 | text[np.where(rest, at, at + WINDOW - 1)]
    full = full << 1 | rest
    order = np.argsort(full, kind="stable")
    again = np.zeros(len(full), bool)
    again[order[1:]] = full[order[1:]] == full[order[:-1]]
    return np.split(again, np.cumsum(counts)[:-1])


_SPAN = pa.schema([("did", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _sort_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from runs that come ordered by what they meet by."""
    spans: list[tuple[int, int, int, int]] = []
    ready: list[tuple[tuple[bytes, int], tuple[int, int, int, int]]] = []
    now, group, held = None, {}, 0

    def add(run: tuple[int, int, int, int]) -> None:
        spans.append((run[0], run[1], run[2], run[3] + WINDOW))

    def close() -> int:
        """Distinct runs of the group at hand become ready to be sorted."""
        if len(group) < 2:
            return 0
        ready.extend(group.items())
        return sum(len(c) for c, _ in group)

    def sort() -> None:
        ready.sort(key=lambda x: (x[1][0], x[1][1], x[1][2] + x[0][1]))  # by the place of what they meet by
        for ((_, _), run), again in zip(ready, repeated_windows([c for (c, _), _ in ready], [s for (_, s), _ in ready]), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], again, [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                spans.append((run[0], run[1], run[2] + lo, run[2] + hi - 1 + WINDOW))
        ready.clear()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spans, strict=True), _SPAN, strict=True)], schema=_SPAN)
        spans.clear()
        return made

    for batch in batches:
        for group_key, content, at, did, tid, first, last in zip(*(batch.column(c).to_pylist() for c in ("group", "content", "shared_from", "did", "tid", "first", "last")), strict=True):
            if group_key != now:
                held += close()
                now, group = group_key, {}
                if held > SORTED:
                    sort()
                    held = 0
            run = (did, tid, first, last)
            was = group.get((content, at))
            if was is None or run < was:
                group[content, at] = run
                if was:
                    add(was)
            elif run > was:
                add(run)
        if len(spans) > 50_000:
            yield out()
    close()
    if ready:
        sort()
    if spans:
        yield out()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(did, tid, spans): of each document that loses bytes, what it loses, in order and apart."""
    named = _documents(docs)
    texts = named.where(F.octet_length("text") >= WINDOW).select("did", "tid", F.encode("text", "utf-8").alias("bytes"))
    runs = stage(texts.mapInArrow(_scan, "key long, did long, tid long, at long"), "anchored-runs")
    counts = stage(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
    marked = runs.join(counts, "key").select("did", "tid", (F.shiftleft("at", 1) + F.when(F.col("n") >= HOT, 1).otherwise(0)).alias("mark"))
    # as many as a document's own runs
    marks = stage(marked.groupBy("did", "tid").agg(F.sort_array(F.collect_set("mark")).alias("marks")), "marked-runs", instead_of=(runs, counts))
    found = stage(texts.join(marks, ["did", "tid"]).mapInArrow(_fetch, RUN), "repeated-runs", instead_of=(marks,))
    group = F.xxhash64(F.substring("content", F.col("shared_from") + 1, F.col("shared")), "shared")
    met = found.where("content is not null").withColumn("group", group).repartition("group").sortWithinPartitions("group")
    spans = met.mapInArrow(_sort_groups, "did long, tid long, start long, stop long")
    spans = spans.unionByName(found.where("content is null").select("did", "tid", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("stop")))
    spans = spans.groupBy("did", "tid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return stage(spans.withColumn("spans", joined_spans(F.col("spans"))), "repeated-spans", instead_of=(found,))


def joined_spans(spans: Column) -> Column:
    """Ordered spans, those that overlap or touch as one."""
    def add(held: Column, span: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(held) > 0) & (span["start"] <= last["stop"]), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(span)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            at = 0
            parts = []
            for span in spans or ():
                parts.append(text[at : span["start"]])
                at = span["stop"]
            kept.append(b"".join([*parts, (text or b"")[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("spans"), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row of ``docs`` (doc_id, text) with what it loses and the bytes that stay."""
    lost = repeated_spans(docs)
    held = _documents(docs).join(lost, ["did", "tid"], "left").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "spans", F.encode("text", "utf-8").alias("bytes"))
    return held.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    lost = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")), F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", lost.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
