"""Exact top-k search with no random access.

Queries are ranked against all documents by BM25 with integer weights, so sums and
ties are exact. Every input partition is a shard with one list for each query term,
sorted by weight. A query reads its lists in step, a block at a time, and keeps for
each document met a lower bound (what has been read) and an upper bound (plus the
last weight read of every list where it hasn't been met). It stops as soon as no
document outside the best k, met or not, can reach the k-th lower bound; the
winners' missing weights are then resolved by reading on. A shard's best k contain
every winner of the whole that lies in it, so the lists of k are all that is
shuffled, and the cost grows with the number of shards.

Document frequencies, lengths and the number of documents come from a first pass
over all documents. Queries are broadcast in batches of ``batch`` rows, so what a
task holds does not grow with their number.

Defined results
---------------
* null, empty and wordless documents are never found; such queries find nothing.
* a query with fewer than k matching documents has fewer rows.
* equal scores are ordered by document id, nulls last; rows that repeat an id are documents of their own.
* repeated query rows each get their results (``query`` numbers are by id, then text).
* other columns play no part. Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Words, as_strings, slices
from .common import col, require

K1, B = 1.2, 0.75


def nra(lists: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents by (total weight descending, rank) and their totals.

    ``lists`` hold (documents, weights) by descending weight; ``rank`` orders ties.
    """
    lists = [x for x in lists if len(x[0])]
    m, n = len(lists), len(rank)
    none = np.zeros(0, np.int64)
    if not m:
        return none, none
    low = np.zeros(n, np.int64)
    seen = np.zeros((m, n), bool)
    last = np.array([w[0] for _, w in lists], np.int64)
    read = 0
    while True:
        for t, (docs, weights) in enumerate(lists):
            part = slice(read, read + block)
            low[docs[part]] += weights[part]
            seen[t, docs[part]] = True
            last[t] = weights[min(read + block, len(weights)) - 1] if read + block < len(weights) else 0
        read += block
        met = np.flatnonzero(low)
        done = not last.any()
        if done or len(met) >= k:
            order = np.lexsort((rank[met], -low[met]))
            top = met[order[:k]]
            if done:
                return top, low[top]
            bar = low[top[-1]]
            if last.sum() < bar:
                rest = met[order[k:]]
                rest = rest[low[rest] + last.sum() >= bar]
                high = low[rest] + last @ ~seen[:, rest]
                if not len(rest) or high.max() < bar:
                    break
        block *= 2
    total = low[top].copy()
    for docs, weights in lists:  # resolve: read on for the winners only
        tail = docs[read:]
        at = np.flatnonzero(np.isin(tail, top))
        for p in at:
            total[top == tail[p]] += weights[read + p]
    order = np.lexsort((rank[top], -total))
    return top[order], total[order]


def _terms(words: Words, vocabulary: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of the vocabulary's terms in a slice."""
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    hit = vocabulary[at] == words.hash
    cell, tf = np.unique(words.doc[hit] * len(vocabulary) + ids[at[hit]], return_counts=True)
    return cell // len(vocabulary), cell % len(vocabulary), tf


def _count_rows(vocabulary: np.ndarray):
    """Partial (term, n): document frequencies, and at -1 and -2 the documents with words and all words."""
    every = np.arange(len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        docs = total = 0
        for batch in batches:
            texts = as_strings(batch.column(0))
            for a, b in slices(texts):
                words = Words(texts.slice(a, b - a))
                df += np.bincount(_terms(words, vocabulary, every)[1], minlength=len(df))
                docs += int((words.count > 0).sum())
                total += len(words.hash)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, total]))], ["term", "n"])

    return run


def _search_rows(vocabulary: np.ndarray, idf: np.ndarray, mean: float, queries: list[tuple[int, np.ndarray]], k: int, id_type: pa.DataType):
    every = np.arange(len(vocabulary))

    def shard(ids: list[pa.Array], parts: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_arrays([x.cast(id_type) for x in ids])
        rank = pc.rank(whole, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
        doc, term, weight = (np.concatenate([p[x] for p in parts]) for x in range(3))
        order = np.lexsort((rank[doc], -weight, term))
        doc, term, weight = doc[order], term[order], weight[order]
        begin = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        out_q, out_d, out_s = [], [], []
        for q, own in queries:
            top, total = nra([(doc[begin[t] : begin[t + 1]], weight[begin[t] : begin[t + 1]]) for t in own], rank, k)
            out_q += [q] * len(top)
            out_d.append(top)
            out_s.append(total)
        at = np.concatenate(out_d) if out_d else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), whole.take(pa.array(at)), pa.array(np.concatenate(out_s) if out_s else at)], ["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, held = [], [], 0, 0
        for batch in batches:
            texts = as_strings(batch.column(1))
            for a, b in slices(texts):
                words = Words(texts.slice(a, b - a))
                doc, term, tf = _terms(words, vocabulary, every)
                weight = np.floor(idf[term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * words.count[doc] / mean)) * 1000 + 0.5).astype(np.int64)
                some = weight > 0
                parts.append(((doc + n)[some].astype(np.int32), term[some].astype(np.int32), weight[some].astype(np.int32)))
                ids.append(batch.column(0).slice(a, b - a))
                n += b - a
                held += int(some.sum())
                if held > 4_000_000:
                    yield from shard(ids, parts, n)
                    ids, parts, n, held = [], [], 0, 0
        if n:
            yield from shard(ids, parts, n)

    return run


def search(
    queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", batch: int = 2000
) -> DataFrame:
    """(query, query id, rank, id, score) of the k best documents of every query; see the module's text."""
    require(queries, query_id, query_text)
    require(docs, id_col, text_col)
    numbered = queries.select(col(query_id).alias("qid"), col(query_text).alias("text")).orderBy(F.col("qid").asc_nulls_last(), "text")
    given = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind, q_kind = docs.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    spark, found, start = docs.sparkSession, [], 0
    rows: list = []

    def flush() -> None:
        texts = Words(pa.array([r["text"] or "" for r in rows], pa.string()))
        vocabulary = np.unique(texts.hash)
        own = [(start + d, np.searchsorted(vocabulary, np.unique(texts.hash[texts.first[d] : texts.first[d + 1]]))) for d in range(len(rows))]
        if len(vocabulary):
            stats = dict(given.select("text").mapInArrow(_count_rows(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
            n, total = stats.pop(-1, 0), stats.pop(-2, 0)
            df = np.zeros(len(vocabulary))
            df[np.array(list(stats), np.int64)] = list(stats.values())
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            best = given.mapInArrow(_search_rows(vocabulary, idf, total / max(n, 1), own, k, _arrow_type(docs, id_col)), f"query long, id {kind}, score long")
            found.append(best.join(F.broadcast(spark.createDataFrame([(start + i, r["qid"]) for i, r in enumerate(rows)], f"query long, qid {q_kind}")), "query"))

    for row in numbered.toLocalIterator():
        rows.append(row)
        if len(rows) == batch:
            flush()
            start, rows = start + len(rows), []
    if rows:
        flush()
    if not found:
        return spark.createDataFrame([], f"query long, {query_id} {q_kind}, rank int, {id_col} {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    whole = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return whole.select("query", F.col("qid").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def _arrow_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[id_col].dataType)
