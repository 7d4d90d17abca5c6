"""Near-dedup by SimHash with a Gray-order hierarchical index.

A document's words (lower-cased runs of letters, digits and symbols such as # or $,
so that a copy strewn with symbols is no near copy; plain words of under four bytes
weigh a quarter) are folded into a signed count sketch, its counts are damped by a
logarithm, and the signs of 256 random projections of that are the fingerprint. Documents whose fingerprints
differ in at most ``max_distance`` bits are near duplicates; the groups are the
connected components of that relation, and one document of each group stays.

Search. Equal fingerprints become one node first. Every node is put into
``tables`` buckets, each keyed by its own choice of ``key_bits`` bits; a pair at
distance d meets in one table with probability C(256-d, key_bits) / C(256, key_bits). Both numbers
follow from the number of nodes (``bucket_plan``): buckets hold some 64, and a pair
at the limit itself is found with 0.99, a nearer one more surely (0.99999 at 20), at
every size; the tables grow as about the 0.3rd power of the nodes. Inside a bucket the
fingerprints are sorted by Gray rank, runs of
``FAN`` neighbours become nodes that hold the bits on which all members agree,
and so on upwards; a node's own pattern leaves out what its parent has already
tested. Every fingerprint then descends as a query, adding the differences of the
patterns that it passes, and a whole group is dropped as soon as the sum exceeds
the distance, or if its members are joined to the query already. Buckets report the
star of each local component, so a group of thousands yields thousands of edges,
not millions, without losing a connection.

Only fingerprints are shuffled, and the text once for the final choice.

Defined results
---------------
* null, empty or wordless texts have no fingerprint: they are never compared and all stay.
* rows that repeat an id and its text are one document: one of them stays, chosen by a hash of the other columns.
* of a group the smallest id stays (null ids last, then the smallest text digest).
* other columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U64, Words, as_strings, slices
from .common import col, durable, fresh, other_columns_hash, require
from .components import components

BITS, DIMS, FAN = 256, 4096, 8
_FRONTIER = 1 << 20
_PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _projection() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(0, 2, size=(DIMS, BITS)).astype(np.float32) * 2 - 1


def table_bits(tables: int, key_bits: int) -> np.ndarray:
    """The bits that key each table: disjoint choices first, then others."""
    rng = np.random.Generator(np.random.PCG64(11))
    picks: list[np.ndarray] = []
    while len(picks) < tables:
        picks += list(rng.permutation(BITS)[: BITS // key_bits * key_bits].reshape(-1, key_bits))
    return np.array(picks[:tables])


def fingerprints(texts: pa.Array, projection: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 256) bits and whether each text has any word."""
    projection = _projection() if projection is None else projection
    bits, has = [np.zeros((0, BITS), bool)], [np.zeros(0, bool)]
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a), symbols=True)
        weight = np.where((words.end - words.start >= 4) | ~_PLAIN[words.data[words.start]], 1.0, 0.25)
        weight[(words.hash >> U64(40)) & U64(1) == 1] *= -1
        cell = words.doc * DIMS + (words.hash & U64(DIMS - 1)).astype(np.int64)
        sketch = np.bincount(cell, weights=weight, minlength=(b - a) * DIMS).astype(np.float32).reshape(b - a, DIMS)
        # damped counts, in 64ths so that float32 sums are exact in any order
        damped = np.copysign(np.floor(np.log2(np.abs(sketch) + 1) * 64) / 64, sketch)
        bits.append(damped @ projection > 0)
        has.append(words.count > 0)
    return np.concatenate(bits), np.concatenate(has)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order, as bits."""
    return np.bitwise_xor.accumulate(bits.astype(np.uint8), axis=1)


def from_rank(rank: np.ndarray) -> np.ndarray:
    """The code at each place: the inverse of ``gray_rank``."""
    out = rank.astype(np.uint8).copy()
    out[:, 1:] ^= rank[:, :-1].astype(np.uint8)
    return out


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1).astype(np.int32)


def near_roots(bucket: np.ndarray, code: np.ndarray, limit: int) -> np.ndarray:
    """The least position of each code's component under "same bucket and within ``limit`` bits"; codes (n, 4 uint64) sorted by bucket, then Gray rank.

    Neighbours in Gray order are joined first; then the codes descend in blocks, and a group whose members all lie in the
    query's component is passed over, so a cluster of n near copies costs some n comparisons, not n squared.
    """
    n = len(bucket)
    if n < 2:
        return np.arange(n)
    opens = np.append(True, bucket[1:] != bucket[:-1])
    head = np.flatnonzero(opens)
    place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    levels = [(np.arange(n + 1), np.full_like(code, ~U64(0)), code, None)]  # first leaf of each node (n+1), mask, value, first child
    size = 1
    while True:
        size *= FAN
        start = np.flatnonzero(place % size == 0)
        agree = ~(np.bitwise_and.reduceat(code, start) ^ np.bitwise_or.reduceat(code, start))
        below = levels[-1][0]
        leaf = np.append(start, n)
        levels.append((leaf, agree, code[start] & agree, np.searchsorted(below, leaf)))
        if len(start) == len(head):
            break
    top = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    beside = np.flatnonzero(~opens[1:] & (_ones(code[1:] ^ code[:-1]) <= limit))
    root = local_roots(n, beside, beside + 1)
    done, step = 0, 16
    while done <= place.max():
        query = np.flatnonzero((place >= done) & (place < done + step))
        i, j = _descend(levels, code, query, top[query], root, limit)
        if len(i):
            root = local_roots(n, np.append(np.arange(n), i), np.append(root, j))
        done, step = done + step, min(2 * step, 4096)
    return root


def _descend(levels: list[tuple], code: np.ndarray, query: np.ndarray, top: np.ndarray, root: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, within ``limit`` bits of which i is a query and j isn't in its component."""
    one = [np.minimum.reduceat(root, leaf[:-1]) for leaf, *_ in levels]
    one = [np.where(low == np.maximum.reduceat(root, leaf[:-1]), low, -1) for low, (leaf, *_) in zip(one, levels)]  # the component of all members, or -1
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    work = [(len(levels) - 1, query, top, np.zeros(len(query), np.int32))]  # a root's pattern agrees with all its members
    while work:
        level, query, node, sum_ = work.pop()
        if level == 0:
            found_i.append(query)
            found_j.append(node)
            continue
        _, mask, _, child = levels[level]
        leaf, child_mask, child_value, _ = levels[level - 1]
        many = child[node + 1] - child[node]
        if many.sum() > _FRONTIER and len(query) > 1:
            half = len(query) // 2
            work += [(level, query[half:], node[half:], sum_[half:]), (level, query[:half], node[:half], sum_[:half])]
            continue
        parent = np.repeat(np.arange(len(query)), many)
        below = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(child[node], many)
        open_ = (leaf[below + 1] > query[parent] + 1) & (one[level - 1][below] != root[query[parent]])
        parent, below = parent[open_], below[open_]
        q = query[parent]
        fresh_bits = child_mask[below] & ~mask[node[parent]]
        total = sum_[parent] + _ones((code[q] ^ child_value[below]) & fresh_bits)
        near = total <= limit
        if near.any():
            work.append((level - 1, q[near], below[near], total[near]))
    return np.concatenate(found_i), np.concatenate(found_j)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each position's component under the pairs (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        while (hop := new[new]).tobytes() != new.tobytes():
            new = hop
        if (new == root).all():
            return root
        root = new


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _rank_rows(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = _projection()
        for batch in batches:
            bits, has = fingerprints(as_strings(batch.column(text_at)), projection)
            packed = np.packbits(gray_rank(bits), axis=1)
            rank = pa.array([r.tobytes() if h else None for r, h in zip(packed, has)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c for x, c in enumerate(batch.columns) if x != text_at], rank], [*[c for x, c in enumerate(batch.schema.names) if x != text_at], "rank"])

    return run


def _bucket_rows(tables: int, key_bits: int):
    picks = table_bits(tables, key_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(key_bits)[::-1]
        for batch in batches:
            packed = _matrix(batch.column(0))
            bits = from_rank(np.unpackbits(packed, axis=1))
            for t, pick in enumerate(picks):
                key = (bits[:, pick].astype(np.int64) * weights).sum(axis=1) + (t << key_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["bucket", "rank"])

    return run


def _edge_rows(limit: int):
    def edges(bucket: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        code = np.ascontiguousarray(np.packbits(from_rank(np.unpackbits(packed, axis=1)), axis=1)).view(U64)
        root = near_roots(bucket, code, limit)
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([_binary(packed[hung]), _binary(packed[root[hung]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1))))
            rows += batch.num_rows
            if rows >= 50_000 and held[-1][0][-1] != held[0][0][0]:
                bucket, packed = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield edges(bucket[:cut], packed[:cut])
                held, rows = [(bucket[cut:], packed[cut:])], len(bucket) - cut
        if held:
            yield edges(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return run


def bucket_plan(nodes: int, limit: int, recall: float = 0.99) -> tuple[int, int]:
    """(tables, key bits) for a number of fingerprints: buckets of some 64, and tables enough to find a pair at the limit itself with ``recall``."""
    key_bits = min(max((max(nodes, 1) - 1).bit_length() - 6, 8), 40)
    meet = math.prod((BITS - limit - i) / (BITS - i) for i in range(key_bits))
    return math.ceil(math.log(1 - recall) / math.log1p(-meet)), key_bits


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell apart all rows that aren't repeated whole."""
    parts = [col(id_col), col(text_col), other_columns_hash(docs, id_col, text_col), col(id_col).isNull(), col(text_col).isNull()]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts[::-1])]


def _ranked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, k1, k2, rank) of every row, in a durable table."""
    k1, k2 = _row_keys(docs, id_col, text_col)
    given = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("digest"), k1.alias("k1"), k2.alias("k2"), col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return durable(given.mapInArrow(_rank_rows(4), f"id {id_type}, digest long, k1 long, k2 long, rank binary"))


def _grouped(ranks: DataFrame, max_distance: int, tables: int | None, key_bits: int | None) -> DataFrame:
    """``ranks`` with ``grp``."""
    nodes = ranks.where("rank IS NOT NULL").select("rank").distinct()
    if tables is None or key_bits is None:
        tables, key_bits = bucket_plan(nodes.count(), max_distance)
    buckets = nodes.mapInArrow(_bucket_rows(tables, key_bits), "bucket long, rank binary")
    sorted_ = buckets.repartition("bucket").sortWithinPartitions("bucket", "rank")
    roots = components(sorted_.mapInArrow(_edge_rows(max_distance), "a binary, b binary"))
    return ranks.join(roots, ranks["rank"] == roots["node"], "left").withColumn("grp", F.coalesce("root", "rank"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 44, tables: int | None = None, key_bits: int | None = None) -> DataFrame:
    """(id, digest, grp) of every distinct (id, text digest); grp is null where there is no fingerprint, else the same for near duplicates."""
    require(docs, id_col, text_col)
    return _grouped(_ranked(docs, id_col, text_col), max_distance, tables, key_bits).select("id", "digest", "grp").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 44, tables: int | None = None, key_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; see the module's text."""
    require(docs, id_col, text_col)
    groups = _grouped(_ranked(docs, id_col, text_col), max_distance, tables, key_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("digest"), F.col("k1"), F.col("k2"))).alias("w")
    best = groups.where("grp IS NOT NULL").groupBy("grp").agg(first)
    alone = groups.where("grp IS NULL").groupBy("id", "digest").agg(first)
    k1, k2, row, n1, n2 = fresh(docs, "k1", "k2", "row", "n1", "n2")
    stay = best.select("w").unionByName(alone.select("w")).select(F.col("w.k1").alias(n1), F.col("w.k2").alias(n2))
    keys = _row_keys(docs, id_col, text_col)
    rows = docs.select(keys[0].alias(k1), keys[1].alias(k2), F.struct(*[col(c) for c in docs.columns]).alias(row))
    once = rows.groupBy(k1, k2).agg(F.first(row).alias(row))  # rows repeated whole are one before they are shuffled
    kept = once.join(stay, (F.col(k1) == F.col(n1)) & (F.col(k2) == F.col(n2)), "left_semi")
    return kept.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
