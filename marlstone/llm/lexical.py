"""Ranked lexical search of many queries at once: a blocked sparse matrix product.

The scores of all items for all documents are the product of two sparse
matrices: item x term, how often (or, for the scores, whether) an item holds a
term, and term x document, the integer weight of a term in a document.

* Items come in blocks of about ``BLOCK_TERMS`` entries, so what a block sends to
  the executors is bounded whatever the table of items.
* Documents are read once for each block of items: their terms that the block
  knows are counted and written, with the lengths of all documents.  Document
  frequencies and lengths are sums over what was written.
* A task takes its documents in blocks, turns their rows around by term, and for
  every item merges the rows of its terms into one array of sums (Gustavson's
  algorithm).  It keeps the best ``k`` of each item from block to block.
* What the tasks kept is reduced natively: the best k of some tasks, then of all.

Words are known by 64 hashed bits.  Scores are 64-bit integers; the length term
is computed without bounds.

Cases.  Null or empty texts, and texts without a term, are no documents here and
no items.  Rows of one item id make one item.  Documents whose ids repeat are
ranked one by one; null ids come last among equals.  Fewer than k documents with
a score above 0: all of them.  Empty tables give no rows.  Texts of any length
are read whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .base import stage

K = 50
#: Entries of the item matrix in a block, and documents in a block of a task.
BLOCK_TERMS, BLOCK_DOCS = 500_000, 8192
#: Tasks whose results are reduced together first.
FAN_IN = 64

_COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, score long, task int"


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, word hashes, words per row) of a batch's texts."""
    return wordhash.slices(batch.column("text").to_pylist(), wordhash.BY_LETTER)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of ``items`` (item_id, text)."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, counts in _groups(batch):
                owner = np.repeat(np.arange(first, last), counts)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), pa.array(words.astype(np.int64))], names=["item_id", "term"])

    words = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(read, "item_id long, term long")
    return words.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def count_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Of every document with a term: its length and its counts of the terms in the sorted ``vocabulary``, by their places there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, last, words, counts in _groups(batch):
                owner = np.repeat(np.arange(last - first), counts)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                met = known[at] == words
                cell, times = np.unique(owner[met] * len(known) + at[met], return_counts=True)
                ends = np.searchsorted(cell, np.arange(last - first + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % len(known), times)]
                some = pa.array(np.flatnonzero(counts))
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([x.take(some) for x in (ids, pa.array(counts.astype(np.int64)), *lists)], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, _COUNTED)


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * frequency + 1))).astype(np.int64)


class Best:
    """The k best documents of each item so far, ties to the smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, lacks: np.ndarray) -> None:
        was = self.held[item]
        if len(was[0]) == self.k:
            able = scores >= was[0][-1]
            scores, ids, lacks = scores[able], ids[able], lacks[able]
        if len(scores) > 4 * self.k:
            able = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, lacks = scores[able], ids[able], lacks[able]
        if len(scores):
            all_ = [np.concatenate(x) for x in zip(was, (scores, ids, lacks), strict=True)]
            order = np.lexsort((all_[1], all_[2], -all_[0]))[: self.k]
            self.held[item] = tuple(x[order] for x in all_)


def product_block(rows: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_terms: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each item's scores of one block of documents: Gustavson's row merging.

    ``rows``: each item's terms and factors; entries of the other matrix are (term, column, impact).
    """
    order = np.argsort(terms, kind="stable")
    columns, impacts = columns[order], impacts[order]
    starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
    for item, (own, factors) in enumerate(rows):
        sums = np.zeros(width, np.int64)
        for term, factor in zip(own.tolist(), factors.tolist(), strict=True):
            lo, hi = starts[term], starts[term + 1]
            sums[columns[lo:hi]] += factor * impacts[lo:hi]  # a document stands once in a term's row
        yield item, sums


def _search_block(docs: DataFrame, block: pa.Table, k: int, repeats: bool) -> DataFrame | None:
    """(item_id, doc_id, score, task) of one block of items: the k best of each task."""
    spark = docs.sparkSession
    vocabulary, place = np.unique(block["term"].to_numpy().astype(np.uint64), return_inverse=True)
    ids = block["item_id"].to_pylist()
    items = list(dict.fromkeys(ids))
    number = {x: i for i, x in enumerate(items)}
    owner = np.array([number[x] for x in ids])
    times = block["times"].to_numpy() if repeats else np.ones(len(ids), np.int64)
    rows = [(place[owner == i], times[owner == i]) for i in range(len(items))]

    counted = stage(count_terms(docs, vocabulary), "term-counts")
    n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    met = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # at most a block's terms
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[met["t"].to_numpy()] = met["df"].to_numpy()
    shared = spark.sparkContext.broadcast((rows, term_weights(frequency, n_docs)))

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, weights = shared.value
        best = Best(len(own), k)
        for whole in batches:
            for first in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(first, BLOCK_DOCS)
                held = batch.column("doc_id")
                lacks, doc_ids = held.is_null().to_numpy(False), held.fill_null(0).to_numpy()
                share = np.array([50 + 50 * n * n_docs // length for n in batch.column("n").to_pylist()], np.int64)
                terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
                columns = np.repeat(np.arange(batch.num_rows), np.array([len(x) for x in batch.column("terms")], np.int64))
                tf = counts.astype(np.int64)
                impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * share[columns]))
                for item, sums in product_block(own, terms, columns, impacts, len(weights), batch.num_rows):
                    some = np.flatnonzero(sums > 0)
                    best.add(item, sums[some], doc_ids[some], lacks[some])
        task = TaskContext.get().partitionId()
        for item, (scores, doc_ids, lacks) in enumerate(best.held):
            if len(scores):
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(scores), pa.int32()), "doc_id": pa.array(doc_ids, mask=lacks), "score": scores, "task": pa.array([task] * len(scores), pa.int32())})

    found = counted.mapInArrow(multiply, _FOUND)
    names = spark.createDataFrame(list(enumerate(items)), "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score", "task")  # as many as a block's items


def rank(docs: DataFrame, items: DataFrame, k: int = K, repeats: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    With ``repeats`` a term counts as often as the item holds it, else once.
    """
    terms = stage(item_terms(items), "item-terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    out = None
    for b in range(blocks):
        block = terms.where(F.col("block") == b).drop("block").toArrow()  # about BLOCK_TERMS entries, or one item's
        found = _search_block(docs, block, k, repeats) if block.num_rows else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", F.floor(F.col("task") / FAN_IN)).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("task")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


#: The contract in SQL, by brute force.
SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM d),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
