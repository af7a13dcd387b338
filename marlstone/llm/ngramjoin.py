"""Similarity join of word-shingle sets: a size-aware heavy-light join.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z folded).
Documents of equal sets are one class from the start.  Two sets are linked when
``100 * intersection >= 75 * union``.

All sets order their elements alike, rare first, by a sketch of the counts of
the whole corpus (the order decides only the cost).  A set of size n overlaps
any partner in t = ceil(0.75 n) elements or more, so

* **light** sets, of size up to a boundary, enumerate the 2-subsets of their first
  n - t + 2 elements: linked light sets share one;
* **heavy** sets scan the inverted lists of their first n - t + 1 elements; light
  sets large enough to be linked to a heavy one are entered in those lists too.

The boundary is the size with the least cost over the corpus's histogram of
sizes.  Both kinds of key make one table of postings; those whose key no other
set holds are dropped.  ``rest`` is the number of a set's elements from a posting
on: a partner first met there can share no more.

Pairs are made in two steps.  First every set is verified against a few centres
of its lists, those with the largest rest for their size; that contracts groups
of near copies without making their pairs.  Then all pairs whose ends are still
apart are made under filters that no link violates, and verified by their whole
sets.  Linked sets of sizes a and b share o = ceil(3 (a + b) / 7) elements or
more: they first meet where both have a rest of o, and among their posted first
elements they share at least o - ceil(0.75 max(a, b)) + 1.  Components of the
links are the classes.

Null and blank texts have size 0 and are linked with nothing.  Null ids never
name a class unless it has no other.  Repeated rows share a class.  Extra
columns are ignored.  Sets are equal if 128 hashed bits are; shingles are known
by 64.  The pruning deals hot lists over salts; the later joins have plain
tables on both sides, so that Spark splits the hot keys; only the sketch, of a
fixed size, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .base import stage, unused
from .graph import components, contracted

SHINGLE = 5
PERCENT = 75
#: Counters of the sketch, and counters in a block of it.
SKETCH_BITS, BLOCK = 22, 4096
#: Largest size that the boundary search considers.
LIGHT_AT_MOST = 64
#: Cost of scanning an inverted list against that of one enumerated subset.
SCAN_COST = 3.0
#: Postings of a key wanted under one salt, beyond the sketch's mean.
LIST_ROWS = 20_000
POSTING_ROWS = 100_000
#: Rows of hashes up to which they are broadcast; beyond, the join is by shuffle.
BROADCAST_ROWS = 500_000
#: Kinds of posting: a light set's element, a heavy set's, a light set's subset.
LIGHT, HEAVY, SUBSET = 0, 1, 2

_TAPS = [np.uint64(int(x) | 1) for x in np.random.default_rng(41).integers(1, 2**63, SHINGLE)]
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, words, counts in wordhash.slices(texts, wordhash.BY_SPACE):
        with np.errstate(over="ignore"):
            n = max(0, len(words) - SHINGLE + 1)
            mixed = np.zeros(n, np.uint64)
            for k, tap in enumerate(_TAPS):
                mixed += words[k : k + n] * tap
            mixed = wordhash.mix(mixed)
            at = 0
            for c in counts:
                if c >= SHINGLE:
                    yield np.unique(mixed[at : at + c - SHINGLE + 1])
                elif c:
                    whole = sum((words[at + k] * _TAPS[k] for k in range(c)), np.uint64(c) << np.uint64(60))
                    yield wordhash.mix(np.array([whole], np.uint64))
                else:
                    yield _EMPTY
                at += c


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        sums = [wordhash.mix(shingles ^ np.uint64(x)).sum(dtype=np.uint64) + np.uint64(len(shingles)) for x in (0xA5A5A5A5A5A5A5A5, 0x3C3C96965A5A0F0F)]
    return int(sums[0].astype(np.int64)), int(sums[1].astype(np.int64))


def _texts(frame: pd.DataFrame) -> list[str | None]:
    return frame["text"].where(frame["text"].notna(), None).tolist()


def _described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document: set id and size; at the end, the task's sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for frame in frames:
        sids, sizes = [], []
        for s in shingle_sets(_texts(frame)):
            sids.append(set_id(s))
            sizes.append(len(s))
            # the elements are sorted, so equal counters are neighbours
            at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            sketch[at[first]] += np.diff(np.r_[first, len(at)]).astype(np.int32)
        yield pd.DataFrame({
            "doc_id": frame["doc_id"], "sid": pd.Series([a for a, _ in sids], dtype="int64"), "sid2": pd.Series([b for _, b in sids], dtype="int64"),
            "n": pd.Series(sizes, dtype="int64"), "counts": None, "block": -1, "text_hash": frame["text_hash"],
        })
    blocks = sketch.reshape(-1, BLOCK)
    for first in range(0, len(blocks), 64):
        some = [k for k in range(first, first + 64) if k < len(blocks) and blocks[k].any()]
        if some:
            packed = [zlib.compress(np.minimum(blocks[k], 65535).astype("<u2").tobytes(), 1) for k in some]
            yield pd.DataFrame({"doc_id": pd.Series([None] * len(some), dtype=object), "sid": 0, "sid2": 0, "n": 0, "counts": packed, "block": some, "text_hash": 0})


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up blocks as they stream by, then gives eighths of their logarithms."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for block, packed in zip(frame["block"], frame["counts"], strict=True):
            part = np.frombuffer(zlib.decompress(packed), "<u2")
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.astype(np.int64)
    rank = lambda v: np.round(8 * np.log2(1 + v)).clip(0, 255).astype(np.uint8).tobytes()
    yield pd.DataFrame({"block": pd.Series(list(sums), dtype="int64"), "ranks": [rank(v) for v in sums.values()]})


def prefix(n: int, common: int = 1) -> int:
    """How many first elements of a set of size n share ``common`` with any linked set's."""
    return min(n, n - -(-PERCENT * n // 100) + common)


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which sets are light: least total cost over the sizes' counts."""
    def cost(x: int) -> float:
        light = sum(c * prefix(n, 2) * (prefix(n, 2) - 1) / 2 for n, c in sizes.items() if n <= x)
        lists = sum(c * prefix(n) * (SCAN_COST if n > x else 1) for n, c in sizes.items() if 100 * n >= PERCENT * (x + 1))
        return light + lists

    return min(range(1, LIGHT_AT_MOST + 1), key=cost)


def _postings(shared, light_to: int, mean: float):
    """(key, salt, salts, sid, n, rest, kind) for the prefix elements and subsets of each set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = np.frombuffer(shared.value, np.uint8)
        done: set[tuple[int, int]] = set()
        for frame in frames:
            held: list[tuple] = []
            room = 0
            for s in shingle_sets(_texts(frame)):
                n = len(s)
                if n < 2:  # a set of one element is linked only with equal sets
                    continue
                both = set_id(s)
                if both in done:
                    continue
                done.add(both)
                rank = ranks[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = prefix(n, 2)
                order = (rank.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(order[first])]
                element, rank = s[first], rank[first]
                if n <= light_to:
                    i, j = np.triu_indices(p, 1)
                    with np.errstate(over="ignore"):
                        subset = wordhash.mix(np.minimum(element[i], element[j]) * _TAPS[0] + np.maximum(element[i], element[j]) * _TAPS[1])
                    held.append((subset, np.minimum(rank[i], rank[j]), np.full(len(subset), n), both[0], n, SUBSET))
                    room += len(subset)
                if 100 * n >= PERCENT * (light_to + 1):
                    q = prefix(n)
                    held.append((element[:q], rank[:q], n - np.arange(q), both[0], n, HEAVY if n > light_to else LIGHT))
                    room += q
                if room > POSTING_ROWS:
                    yield _posting_frame(held, mean)
                    held, room = [], 0
            if held:
                yield _posting_frame(held, mean)

    return run


def _posting_frame(held: list[tuple], mean: float) -> pd.DataFrame:
    key, rank, rest = (np.concatenate([h[k] for h in held]) for k in range(3))
    sid, n, kind = (np.repeat([h[k] for h in held], [len(h[0]) for h in held]) for k in range(3, 6))
    salts = np.ceil(np.maximum(2.0 ** (rank / 8.0) - mean, 1) / LIST_ROWS).astype(np.int32)
    salt = (sid.astype(np.uint64) % salts.astype(np.uint64)).astype(np.int32)
    return pd.DataFrame({"key": key.astype(np.int64), "salt": salt, "salts": salts, "sid": sid, "n": n.astype(np.int32), "rest": rest.astype(np.int32), "kind": kind.astype(np.int8)})


def _shared_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of postings sorted by key, salt, size and set, those with a possible partner under the key.

    That is one of another set within the sizes' ratio.  Repeated ones go.  Salted
    keys stay whole, as partners may be under another salt.
    """
    carry = None
    for frame in frames:
        frame = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
        key, salt = frame["key"].to_numpy(), frame["salt"].to_numpy()
        if not len(key):
            continue
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        carry, frame = frame.iloc[new[-1] :], frame.iloc[: new[-1]]
        yield _kept(frame)
    if carry is not None:
        yield _kept(carry)


def _kept(frame: pd.DataFrame) -> pd.DataFrame:
    columns = ["key", "sid", "n", "rest", "kind"]
    key, salt, sid = (frame[c].to_numpy() for c in ("key", "salt", "sid"))
    same_list = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
    fresh = np.r_[True, ~(same_list & (sid[1:] == sid[:-1]))][: len(frame)]
    frame = frame[fresh]
    if not len(frame):
        return frame[columns]
    key, salt, salts, n = (frame[c].to_numpy() for c in ("key", "salt", "salts", "n"))
    joined = np.zeros(len(frame) + 1, bool)  # to the posting before
    joined[1:-1] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (4 * n[:-1].astype(np.int64) >= 3 * n[1:].astype(np.int64))
    return frame[columns][joined[:-1] | joined[1:] | (salts > 1)]


def _shared(a: str, b: str) -> str:
    """SQL for o, the elements that linked sets of these sizes share at least."""
    return f"((3 * ({a}n + {b}n) + 6) div 7)"


def _wanted(a: str, b: str) -> str:
    """SQL for the posted keys that linked sets share at least; light sets need only one subset."""
    return f"(case when {a}kind = {SUBSET} then 1 else greatest(1, {_shared(a, b)} - (3 * greatest({a}n, {b}n) + 3) div 4 + 1) end)"


def _may_link(a: str, b: str) -> str:
    """SQL for whether sets that meet under a key of these kinds may be linked by it and their sizes."""
    return f"({a}kind = {HEAVY} or {b}kind = {HEAVY} or {a}kind = {SUBSET}) and 4 * least({a}n, {b}n) >= 3 * greatest({a}n, {b}n)"


def _to_centres(lists: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(a, b), and the staged frames it is made of: each set with up to two of the centres of its lists, those with which it shares most keys."""
    half = lambda x: F.pmod(F.xxhash64(x), F.lit(2))
    it = ["n", "rest", "kind", "sid"]
    best = F.struct((F.col("rest") / F.col("n")).cast("float").alias("share"), *it)
    centres = lists.groupBy("key").agg(
        F.min("sid").alias("lo"), F.max("sid").alias("hi"), *[F.max(F.when(half("sid") == k, best)).alias(f"c{k}") for k in (0, 1)]
    )
    # written first, so that Spark can split a hot key of the lists
    centres = stage(centres.where("lo < hi").select("key", "c0", "c1"), "centres")
    drawn = F.array(*[F.struct(*[F.col(f"c{k}.{x}").alias(x) for x in it]) for k in (0, 1)])
    met = lists.join(centres, "key").select(*it, F.explode(drawn).alias("c"))
    met = met.select(*it, *[F.col(f"c.{x}").alias(f"c_{x}") for x in it]).where(f"c_sid is not null and sid <> c_sid and {_may_link('', 'c_')}")
    # a set need not be the centre of all lists that the two share, so half the keys make a pair promising
    met = met.groupBy("sid", F.col("c_sid").alias("c")).agg(F.count("*").alias("keys"), F.first("c_n").alias("c_n"), F.expr(f"first({_wanted('', 'c_')})").alias("wanted"))
    best = F.struct((F.col("keys") / F.col("c_n")).cast("float").alias("share"), "c")
    met = met.where("2 * keys >= wanted").groupBy("sid").agg(*[F.max(F.when(half("c") == k, best)).alias(f"m{k}") for k in (0, 1)])
    met = met.select("sid", F.explode(F.array("m0", "m1")).alias("m")).where("m is not null")
    return met.select(F.greatest("sid", "m.c").alias("a"), F.least("sid", "m.c").alias("b")).distinct(), (centres,)


def _apart(lists: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(a, b), and the staged frames it is made of: all pairs of sets of different components that may be linked."""
    open_ = stage(lists.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "open-keys")
    left = stage(lists.join(open_, "key", "left_semi"), "open-lists", instead_of=(open_,))
    side = lambda x: left.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("sid", "n", "rest", "kind", "root")])
    pairs = side("a").join(side("b"), "key").where(f"a_sid > b_sid and a_root <> b_root and {_may_link('a_', 'b_')} and least(a_rest, b_rest) >= {_shared('a_', 'b_')}")
    pairs = pairs.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).agg(F.expr(f"min({_wanted('a_', 'b_')})").alias("wanted"))
    pairs = stage(pairs, "meeting-pairs", instead_of=(left,))
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    # at most a set's own keys
    keys = stage(lists.join(ends, "sid", "left_semi").groupBy("sid").agg(F.collect_list("key").alias("keys")), "posted-keys")
    side = lambda x: keys.select(F.col("sid").alias(x), F.col("keys").alias(f"{x}_keys"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(F.size(F.array_intersect("a_keys", "b_keys")) >= F.col("wanted")).select("a", "b"), (pairs, keys, lists)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done: set[tuple[int, int]] = set()
    for frame in frames:
        texts = _texts(frame)
        for first in range(0, len(texts), 256):
            ids, sets = [], []
            for s in shingle_sets(texts[first : first + 256]):
                both = set_id(s)
                if both not in done:
                    done.add(both)
                    ids.append(both)
                    sets.append(s.astype(np.int64))
            yield pd.DataFrame({"s": pd.Series([a for a, _ in ids], dtype="int64"), "s2": pd.Series([b for _, b in ids], dtype="int64"), "elements": pd.Series(sets, dtype=object)})


def _verified(made: tuple[DataFrame, tuple[DataFrame, ...]], reps: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The pairs of set ids that are linked, by their whole sets: (a, a2, b, b2).  ``reps`` names a text of each set."""
    pairs = stage(made[0], f"{label}-pairs", instead_of=made[1])
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    needed = stage(reps.join(ends, "sid", "left_semi").select("text_hash").distinct(), f"{label}-texts")
    sent = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = docs.select("text").join(sent, F.xxhash64("text") == F.col("text_hash"), "left_semi")
    sets = texts.mapInPandas(_sets, "s long, s2 long, elements array<long>").groupBy("s", "s2").agg(F.first("elements").alias("e"))
    sets = stage(sets, f"{label}-sets")
    side = lambda x: sets.select(*[F.col(c).alias(x + c[1:]) for c in ("s", "s2")], F.col("e").alias(f"{x}_e"))
    both = F.size(F.array_intersect("a_e", "b_e"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    links = joined.where(100 * both >= PERCENT * (F.size("a_e") + F.size("b_e") - both)).select("a", "a2", "b", "b2")
    return stage(links, f"{label}-links", instead_of=(pairs, needed, sets))


def link_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(members: doc_id, text_hash, sid, sid2, n; links: a, a2, b, b2; the staged frames behind them).  ``docs`` needs doc_id and text.

    The links are as many as make the components, not all there are.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # ids travel as text: among nulls, pandas would make them floating point
    described = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    described = described.mapInPandas(_described, "doc_id string, sid long, sid2 long, n long, counts binary, block long, text_hash long")
    described = stage(described.withColumn("doc_id", F.col("doc_id").cast("bigint")), "shingle-sets")
    members = described.where("block < 0").drop("block", "counts")
    blocks = described.where("block >= 0").select("block", "counts")
    blocks = blocks.repartition(F.col("block")).mapInPandas(_summed, "block long, ranks binary").collect()
    ranks = bytearray(1 << SKETCH_BITS)
    for r in blocks:  # a fixed size, whatever the corpus
        ranks[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["ranks"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(ranks))
    mean = (members.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    sizes = members.where(F.col("n").between(1, 2 * LIGHT_AT_MOST)).groupBy("n").count().collect()
    light_to = boundary({r["n"]: r["count"] for r in sizes})

    postings = docs.select("text").mapInPandas(_postings(shared, light_to, mean), "key long, salt int, salts int, sid long, n int, rest int, kind byte")
    postings = postings.repartition(F.col("key"), F.col("salt")).sortWithinPartitions("key", "salt", "n", "sid")
    lists = postings.mapInPandas(_shared_keys, "key long, sid long, n int, rest int, kind byte")
    lists = stage(lists, "inverted-lists")
    shared.destroy()
    del blocks, ranks
    reps = stage(members.where("n > 1").groupBy("sid", "sid2").agg(F.min("text_hash").alias("text_hash")), "set-texts")

    # Contract: each set against the centres that it shares most keys with.
    links = _verified(_to_centres(lists), reps, docs, "centre")
    roots = contracted(links.select("a", "b"))
    labelled = lists.join(roots, F.col("sid") == F.col("v"), "left").withColumn("root", F.coalesce("root", "sid")).drop("v")
    labelled = stage(labelled, "labelled-lists", instead_of=(lists, roots))
    # Then all pairs still apart.
    late = _verified(_apart(labelled), reps, docs, "open")
    return members, links.union(late), (described, reps, links, late)


def _placed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n and the root of its set's component, which is a name of a set."""
    members, links, made = link_sets(docs)
    name = lambda x: F.concat(F.hex(x), F.lit("."), F.hex(f"{x}2"))
    roots = components(links.select(name("a").alias("a"), name("b").alias("b")))
    placed = members.select("doc_id", "text_hash", "n", name("sid").alias("set"))
    placed = placed.join(roots, F.col("set") == F.col("v"), "left")
    return stage(placed.select("doc_id", "text_hash", "n", F.coalesce("root", "set").alias("root")), "placed-sets", instead_of=(roots, *made))


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    placed = _placed(docs)
    # only classes of several rows; written first, so that Spark can split a hot class
    named = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    out = placed.alias("p").join(stage(named, "class-names").alias("g"), (F.col("p.root") == F.col("g.root")) & (F.col("p.n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (null last), then text hash, then hash of the row.

    Rows without words are in no group and all stay.
    """
    id_, hash_, row_ = unused(docs.columns, "id", "hash", "row")
    everything = _placed(docs)
    placed = everything.where("n > 0")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("k"), F.count("*").alias("rows"))
    kept = stage(kept.where("rows > 1").drop("rows"), "kept-rows")
    grouped = placed.join(kept, "root").select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.expr("doc_id <=> k.doc_id and text_hash = k.text_hash").alias("stays")
    )
    grouped = stage(grouped, "group-rows", instead_of=(kept, everything))
    gone = stage(grouped.where("not stays").select(id_, hash_).distinct(), "removed-rows")
    twice = stage(grouped.where("stays").groupBy(id_, hash_).count().where("count > 1").select(id_, hash_), "repeated-rows", instead_of=(grouped,))
    sent = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    out = docs.join(sent(gone), same, "left_anti")
    if twice.isEmpty():
        return out
    # of repeated rows the one with the least hash; rows of equal hash are equal
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = stage(out.join(sent(twice), same).withColumn(row_, F.xxhash64(*plain)), "repeated-texts")
    first = stage(rows.groupBy(id_, hash_).agg(F.min(row_).alias("first")), "first-rows")
    once = rows.alias("r").join(sent(first).alias("f"), F.expr(f"r.`{id_}` <=> f.`{id_}` and r.`{hash_}` = f.`{hash_}` and r.`{row_}` = f.first"))
    once = once.select("r.*").dropDuplicates([id_, hash_]).select(*docs.columns)
    return out.join(sent(twice), same, "left_anti").unionByName(once)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY 1
"""
