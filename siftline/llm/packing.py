"""Packing of related documents into windows.

1. Vectors. A document's words fall into a signed, damped count sketch of ``SKETCH`` numbers
   (as for SimHash), kept sparse. Documents with the same sketch, copies above all, are one
   node of the graph; nearness is the cosine of the sketches.
2. Neighbours. A tree of median splits, fitted on a bounded sample, cuts the nodes into cells
   of about ``cell_nodes``, whose sizes are even however alike the nodes are. A node belongs to
   one cell and is looked up in the ``probes`` cells whose sample's mean is nearest to it, its
   own among them. Where a cell is near to very many nodes, their lookups are cut into groups,
   each with all members. Inside a cell the search is exact on the whole sketch: the numbers
   that more than one in ``SELDOM`` members have are multiplied densely, however many they
   are, the others by their postings. All weights are whole numbers, so products are the same
   in any order. With one cell the graph is exact; how much more cells find of it is measured
   in README.
3. Paths. In each cell, over the undirected edges inside it, a walk starts at the unvisited
   node of lowest degree (ties by node id), goes on to the nearest unvisited neighbour while
   there is one, and then starts again. Then paths of all cells are joined end to end along the
   edges between their ends, nearest first, in rounds in which every path joins with one other
   at most, until a round joins less than one in a hundred. Joined paths have at most ``cell_nodes`` nodes.
4. Windows. A joined path belongs to the cell where its first piece lies. The documents of a
   cell's paths, in path order and copies in order of id, form one sequence of tokens that is
   cut every ``window_tokens``: all windows but a cell's last are full, and each token of the
   corpus is in exactly one window.

A token is a run of characters other than ASCII white space. Texts are read once and never
shuffled; two bytes for each distinct word of a document are, for each cell that it is looked up in.

Defined results
---------------
* null, empty and blank texts have no tokens and are in no window.
* texts without a letter or digit share one node.
* rows that repeat an id are all packed, each in its own place.
* ids of any type pass through and keep their column's name; where it is one of the new columns' names, these get leading underscores. Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U64, Words, as_strings, byte_view, grouped, slices
from .common import col, durable, fresh, require

SKETCH, BLOCK = 4096, 256
#: Numbers that more than one in SELDOM members have are multiplied densely: a dense product costs some 600 times less than one of a posting.
SELDOM = 24
#: Products of postings at a time; members up to which all products of a cell are held (100 MB).
PRODUCTS, SQUARE = 1 << 17, 5120
#: Every task holds the means of all cells (four kilobytes each); beyond 32 million distinct sketches cells grow instead.
MAX_CELLS = 1 << 13
#: Sampled nodes for each cell, and at least.
PER_CELL, LEAST_SAMPLE = 16, 8192
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def count_tokens(texts: pa.Array) -> np.ndarray:
    data, off = byte_view(texts)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    opens[heads] = solid[heads]
    total = np.append(0, np.cumsum(opens))
    return total[off[1:]] - total[off[:-1]]


def sketches(texts: pa.Array) -> list[bytes]:
    """The nonzero cells of each text's sketch in two bytes each: the step from the cell before, and the weight; nothing where there are no words.

    Steps of more than 255 are made up of steps to cells of weight 0.
    """
    out: list[bytes] = []
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a))
        weight = np.where(words.end - words.start >= 4, 1.0, 0.25)
        weight[(words.hash >> U64(40)) & U64(1) == 1] *= -1
        cell = words.doc * SKETCH + (words.hash & U64(SKETCH - 1)).astype(np.int64)
        sketch = np.bincount(cell, weights=weight, minlength=(b - a) * SKETCH)
        at = np.flatnonzero(sketch)
        damped = np.copysign(np.minimum(np.floor(np.log2(np.abs(sketch[at]) + 1) * 8 + 0.5), 127), sketch[at])
        first = np.searchsorted(at, np.arange(b - a + 1) * SKETCH)
        step = np.diff(at, prepend=0)
        heads = first[:-1][first[:-1] < first[1:]]
        step[heads] = at[heads] % SKETCH + 1
        fill = (step - 1) // 255
        last = np.cumsum(fill + 1) - 1
        pairs = np.tile(np.array([255, 0], np.uint8), (int(last[-1]) + 1 if len(last) else 0, 1))
        pairs[last, 0], pairs[last, 1] = step - 255 * fill, damped.astype(np.int8).view(np.uint8)
        edge = (2 * np.append(0, last + 1)[first]).tolist()
        pairs = pairs.tobytes()
        out += [pairs[x:y] for x, y in zip(edge, edge[1:])]
    return out


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_strings(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count_tokens(texts)), pa.array(sketches(texts), pa.binary())], ["id", "digest", "tokens", "vec"])


class Sparse:
    """Rows of sketches: ``begin`` (n+1), ``cell``, ``weight`` and the rows' lengths."""

    def __init__(self, packed: list[bytes]):
        pairs = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 2)
        begin = np.append(0, np.cumsum(np.array([len(x) // 2 for x in packed], np.int64)))
        row = np.repeat(np.arange(len(packed), dtype=np.int32), np.diff(begin))
        total = np.append(0, np.cumsum(pairs[:, 0], dtype=np.int64))
        weight = pairs[:, 1].view(np.int8)
        real = weight != 0
        self.cell, self.weight, self.row = (total[1:] - total[begin[row]] - 1)[real].astype(np.int32), weight[real].astype(np.float32), row[real]
        self.begin = np.searchsorted(self.row, np.arange(len(packed) + 1))
        size = np.bincount(self.row, weights=self.weight.astype(np.float64) ** 2, minlength=len(packed))
        self.size = np.sqrt(np.maximum(size, 1e-30))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """(len(rows), SKETCH) float32."""
        out = np.zeros((len(rows), SKETCH), np.float32)
        at, row = self.entries(rows)
        out[row, self.cell[at]] = self.weight[at]
        return out

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the rows' entries, and which of ``rows`` each belongs to."""
        n = self.begin[rows + 1] - self.begin[rows]
        row = np.repeat(np.arange(len(rows)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[rows], n), row


class Tree:
    """A complete tree of median splits with ``cells`` (a power of two) leaves, and the means of the sample in its leaves."""

    def __init__(self, sample: Sparse, cells: int):
        self.cells, self.depth = cells, cells.bit_length() - 1
        self.plane = np.zeros((cells, SKETCH), np.float16)
        self.at = np.zeros(cells)
        self.mean = np.zeros((cells, SKETCH), np.float16)
        members = {1: np.arange(len(sample))}
        for node in range(1, cells):
            own = members.pop(node)
            if len(own) > 1:
                some = own[:: max(1, len(own) // 1024)]
                x = sample.dense(some) / sample.size[some, None].astype(np.float32)
                one, two = x[0], x[int((x @ x[0]).argmin())]
                for _ in range(4):
                    left = x @ (one - two) >= np.median(x @ (one - two))
                    one, two = x[left].mean(axis=0), x[~left].mean(axis=0) if (~left).any() else two
                self.plane[node] = (one - two).astype(np.float16)
                score = self._score(sample, own, self.plane[node])
                self.at[node] = float(np.median(score))
                right = score > self.at[node]
            else:
                right = np.zeros(len(own), bool)
            members[2 * node], members[2 * node + 1] = own[~right], own[right]
        for leaf in range(cells):
            own = members[cells + leaf]
            if len(own):
                mean = (sample.dense(own) / sample.size[own, None].astype(np.float32)).sum(axis=0)
                self.mean[leaf] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-9)

    @staticmethod
    def _score(rows: Sparse, which: np.ndarray, plane: np.ndarray) -> np.ndarray:
        at, row = rows.entries(which)
        return np.bincount(row, weights=rows.weight[at] * plane[rows.cell[at]].astype(np.float64), minlength=len(which)) / rows.size[which]

    def home(self, rows: Sparse) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            score = np.bincount(rows.row, weights=rows.weight * self.plane[node[rows.row], rows.cell].astype(np.float64), minlength=len(rows)) / rows.size
            node = 2 * node + (score > self.at[node])
        return node - self.cells

    def near(self, rows: Sparse, which: np.ndarray, home: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells of each row with the nearest means, its home first."""
        like = rows.dense(which) @ self.mean.astype(np.float32).T
        like[np.arange(len(which)), home] = np.inf
        n = min(probes, self.cells)
        some = np.argpartition(-like, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(like, some, axis=1), axis=1, kind="stable")
        return np.take_along_axis(some, order, axis=1)


class Cell:
    """Members of a cell, laid out for products with queries: what most of them have densely, the rest by its postings."""

    def __init__(self, members: Sparse, ids: np.ndarray):
        self.members, self.ids, self.order = members, ids, np.argsort(ids)
        common = np.flatnonzero(np.bincount(members.cell, minlength=SKETCH) * SELDOM > len(members))
        self.slot = np.full(SKETCH, -1, np.int64)
        self.slot[common] = np.arange(len(common))
        often = self.slot[members.cell] >= 0
        self.dense = np.zeros((len(members), len(common)), np.float32)
        self.dense[members.row[often], self.slot[members.cell[often]]] = members.weight[often]
        order = np.argsort(members.cell[~often], kind="stable")
        self.post_row, self.post_weight = members.row[~often][order].astype(np.int64), members.weight[~often][order].astype(np.float64)
        edges = np.searchsorted(members.cell[~often][order], np.arange(SKETCH + 1))
        self.begin, self.end = edges[:-1], edges[1:]
        self.scale = (1 / members.size).astype(np.float32)[None]

    def products(self, queries: Sparse, rows: np.ndarray, begin: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        """Whole numbers, exact in float32: of the queries ``rows`` with the members from ``least`` on, whose postings start at ``begin``."""
        begin = self.begin if begin is None else begin
        m = len(self.members) - least
        at, row = queries.entries(rows)
        slot, cell, weight = self.slot[queries.cell[at]], queries.cell[at], queries.weight[at]
        often = slot >= 0
        x = np.zeros((len(rows), self.dense.shape[1]), np.float32)
        x[row[often], slot[often]] = weight[often]
        dot = x @ self.dense[least:].T
        cell, weight, row = cell[~often], weight[~often].astype(np.float64), row[~often]
        width = self.end[cell] - begin[cell]
        total = np.append(0, np.cumsum(np.bincount(row, weights=width, minlength=len(rows)))).astype(np.int64)
        lo = 0
        while lo < len(rows):  # rows of about PRODUCTS products at a time, which stay in the cache
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PRODUCTS, side="right")) - 1)
            part = slice(*np.searchsorted(row, [lo, hi]))
            w = width[part]
            if w.sum():
                place = np.repeat(begin[cell[part]] - np.cumsum(w) + w, w)
                place += np.arange(len(place))
                to = np.repeat((row[part] - lo) * m - least, w)
                to += self.post_row[place]
                product = np.repeat(weight[part], w)
                product *= self.post_weight[place]
                dot[lo:hi] += np.bincount(to, weights=product, minlength=(hi - lo) * m).reshape(hi - lo, m)
            lo = hi
        return dot

    def best(self, dot: np.ndarray, size: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest members of queries with these products, lengths and ids, themselves left out; inf and 0 pad."""
        n, m = dot.shape
        best, who = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
        like = dot * self.scale
        own = self.order[np.minimum(np.searchsorted(self.ids, query_ids, sorter=self.order), m - 1)]
        own, row = own[self.ids[own] == query_ids], np.flatnonzero(self.ids[own] == query_ids)
        like[row, own] = -np.inf
        low = np.partition(like, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf, np.float32)
        low -= np.abs(low) * np.float32(1e-5)  # rounding decides nothing: ties and order come from exact products
        r, c = np.nonzero(like >= np.maximum(low, np.float32(1e-6))[:, None])  # a product of at least 1 gives 1e-4
        d = 1 - np.round(dot[r, c].astype(np.float64) / (size[r] * self.members.size[c]), 9)
        by = np.lexsort((self.ids[c], d, r))
        r, c, d = r[by], c[by], d[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < k
        best[r[top], rank[top]], who[r[top], rank[top]] = d[top], self.ids[c[top]]
        return best, who

    def among(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest other members of each member. A product serves both of its members where the cell's products fit into memory."""
        m = len(self.members)
        if m > SQUARE:
            return nearest(self, self.members, self.ids, k)
        found, begin = [], self.begin.copy()
        dot = np.zeros((m, m), np.float32)
        for a in range(0, m, BLOCK):
            b = min(a + BLOCK, m)
            dot[a:b, a:] = self.products(self.members, np.arange(a, b), begin, a)
            dot[b:, a:b] = dot[a:b, b:].T
            found.append(self.best(dot[a:b], self.members.size[a:b], self.ids[a:b], k))
            cell = self.members.cell[self.members.begin[a] : self.members.begin[b]]
            begin += np.bincount(cell[self.slot[cell] < 0], minlength=SKETCH)
        return tuple(np.concatenate(x) for x in zip(*found))


def nearest(cell: Cell, queries: Sparse, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest members of each query by (1 - cosine, id), itself left out; inf and 0 pad. Only what shares a number counts."""
    found = [(np.zeros((0, k)), np.zeros((0, k), np.int64))]
    for a in range(0, len(queries), BLOCK):
        rows = np.arange(a, min(a + BLOCK, len(queries)))
        found.append(cell.best(cell.products(queries, rows), queries.size[rows], query_ids[rows], k))
    return tuple(np.concatenate(x) for x in zip(*found))


_FOUND = "array<struct<d:double,nid:long>>"


def _lists(best: np.ndarray, who: np.ndarray) -> pa.Array:
    ok = np.isfinite(best)
    flat = pa.StructArray.from_arrays([pa.array(best[ok]), pa.array(who[ok])], ["d", "nid"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ok.sum(axis=1))), pa.int32()), flat)


def _cell_rows(k: int):
    """(group, cell, nid, member, asks, vec) sorted by group to (cell, nid, found) of those that ask; the cell is null where it isn't the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            home, ids = batch.column(1), batch.column(2).to_numpy()
            member, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in (3, 4))
            packed = batch.column(5)
            own = np.flatnonzero(member)
            if not len(own):
                best = np.full((int(asks.sum()), k), np.inf)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(best), pa.int64()), pa.array(ids[asks]), _lists(best, best.astype(bool).astype(np.int64))], ["cell", "nid", "found"])
                continue
            cell = Cell(Sparse(packed.take(pa.array(own)).to_pylist()), ids[own])
            if asks[own].any():
                yield pa.RecordBatch.from_arrays([home.take(pa.array(own)), pa.array(ids[own]), _lists(*cell.among(k))], ["cell", "nid", "found"])
            others = np.flatnonzero(asks & ~member)
            for a in range(0, len(others), 4096):
                some = others[a : a + 4096]
                found = nearest(cell, Sparse(packed.take(pa.array(some)).to_pylist()), ids[some], k)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[some]), _lists(*found)], ["cell", "nid", "found"])

    return run


def walk(ids: np.ndarray, source: np.ndarray, target: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Order of visit (indices into ``ids``, sorted ascending) over undirected edges given as indices; low degree first, then nearest."""
    n = len(ids)
    s, t, d = np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([dist, dist])
    order = np.lexsort((t, d, s))
    s, t = s[order], t[order]
    _, first = np.unique(s * n + t, return_index=True)
    keep = np.sort(first)
    s, t = s[keep], t[keep]
    begin = np.searchsorted(s, np.arange(n + 1)).tolist()
    t = t.tolist()
    seen, out = [False] * n, []
    for start in np.lexsort((np.arange(n), np.diff(begin))).tolist():
        at = start
        while at >= 0 and not seen[at]:
            seen[at] = True
            out.append(at)
            at = next((x for x in t[begin[at] : begin[at + 1]] if not seen[x]), -1)
    return np.array(out, np.int64)


def _walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, nid, found) sorted by cell to (cell, nid, path, pos, size): a path is named by its first node."""
    for batch in grouped(batches):
        ids = batch.column(1).to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        found = batch.column(2).take(pa.array(order))
        source = np.repeat(np.arange(len(ids)), np.diff(found.offsets.to_numpy()))
        flat = found.flatten()
        theirs, dist = flat.field(1).to_numpy(), flat.field(0).to_numpy()
        target = np.minimum(np.searchsorted(ids, theirs), len(ids) - 1)
        inside = ids[target] == theirs
        source, target = source[inside], target[inside]
        path = walk(ids, source, target, dist[inside])
        # a path goes on where the next node is a neighbour
        edges = np.unique(np.concatenate([source * len(ids) + target, target * len(ids) + source]))
        step = path[:-1] * len(ids) + path[1:]
        goes = edges[np.minimum(np.searchsorted(edges, step), max(len(edges) - 1, 0))] == step if len(edges) else np.zeros(len(step), bool)
        head = np.flatnonzero(np.append(True, ~goes))
        size = np.diff(np.append(head, len(path)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), batch.column(0)[0].as_py())), pa.array(ids[path]), pa.array(np.repeat(ids[path[head]], size)), pa.array(np.arange(len(path)) - np.repeat(head, size)), pa.array(np.repeat(size, size))],
            ["cell", "nid", "path", "pos", "size"],
        )


def join_paths(walked: DataFrame, graph: DataFrame, most: int) -> DataFrame:
    """(path, top, lead, back): the joined path that each path is part of, the nodes before it there, and whether it runs backwards.

    Every round each joined path chooses its nearest free end (ties by node ids) of another one with which it has at most
    ``most`` nodes; pairs that choose each other are joined. Only ends and the edges between them are looked at.
    """
    ends = walked.where((F.col("pos") == 0) | (F.col("pos") == F.col("size") - 1)).select("nid", "path", (F.col("pos") == 0).alias("first"), (F.col("pos") == F.col("size") - 1).alias("last"))
    pairs = graph.select("nid", F.explode("found").alias("x")).select(F.least("nid", "x.nid").alias("u"), F.greatest("nid", "x.nid").alias("v"), F.col("x.d").alias("d")).distinct()
    side = lambda n, c: ends.select(F.col("nid").alias(n), F.col("path").alias(c + "path"), F.col("first").alias(c + "first"), F.col("last").alias(c + "last"))
    edges = durable(pairs.join(side("u", "u"), "u").join(side("v", "v"), "v").where("upath <> vpath"))
    kept = edges.columns
    left = walked.where("pos = 0").count()
    parts = durable(walked.where("pos = 0").select("path", F.col("path").alias("top"), F.lit(0).cast("long").alias("lead"), F.lit(False).alias("back"), F.col("size"), F.col("size").alias("whole")))
    while True:
        of = lambda c: parts.select(F.col("path").alias(c + "path"), *[F.col(x).alias(c + x) for x in ("top", "lead", "back", "size", "whole")])
        free = edges.join(of("u"), "upath").join(of("v"), "vpath").where((F.col("utop") != F.col("vtop")) & (F.col("uwhole") + F.col("vwhole") <= most))
        # a node is free at the front or the rear of its joined path
        front = lambda c: (F.col(c + "lead") == 0) & F.when(F.col(c + "back"), F.col(c + "last")).otherwise(F.col(c + "first"))
        rear = lambda c: (F.col(c + "lead") + F.col(c + "size") == F.col(c + "whole")) & F.when(F.col(c + "back"), F.col(c + "first")).otherwise(F.col(c + "last"))
        free = free.withColumns({"ufront": front("u"), "urear": rear("u"), "vfront": front("v"), "vrear": rear("v")}).where("(ufront OR urear) AND (vfront OR vrear)")
        free = durable(free.select(*kept, "utop", "vtop", "uwhole", "vwhole", "ufront", "urear", "vfront", "vrear"))
        edges = free.select(*kept)  # an edge that isn't free never is again: joined paths only grow
        both = [free.select(F.col(a + "top").alias("top"), F.struct("d", "u", "v").alias("e")) for a in "uv"]
        best = both[0].unionByName(both[1]).groupBy("top").agg(F.min("e").alias("e"))
        pick = lambda c: best.select(F.col("top").alias(c + "top"), F.col("e").alias(c + "e"))
        chosen = free.join(pick("u"), "utop").join(pick("v"), "vtop").where((F.col("ue") == F.col("ve")) & (F.col("ue.u") == F.col("u")) & (F.col("ue.v") == F.col("v")))
        # u's path is laid so that it ends at u, v's so that it begins at v
        chosen = durable(chosen.select("utop", "vtop", "uwhole", "vwhole", (~F.col("urear")).alias("uturn"), (~F.col("vfront")).alias("vturn")))
        joins = chosen.count()
        new = chosen.select(F.col("utop").alias("old"), F.col("utop").alias("new"), F.col("uturn").alias("turn"), F.lit(0).cast("long").alias("shift"), (F.col("uwhole") + F.col("vwhole")).alias("sum")).unionByName(
            chosen.select(F.col("vtop").alias("old"), F.col("utop").alias("new"), F.col("vturn").alias("turn"), F.col("uwhole").alias("shift"), (F.col("uwhole") + F.col("vwhole")).alias("sum"))
        )
        moved = parts.join(new, F.col("top") == F.col("old"), "left")
        turn = F.coalesce("turn", F.lit(False))
        lead = F.when(turn, F.col("whole") - F.col("lead") - F.col("size")).otherwise(F.col("lead")) + F.coalesce("shift", F.lit(0))
        parts = durable(moved.select("path", F.coalesce("new", "top").alias("top"), lead.alias("lead"), (F.col("back") != turn).alias("back"), "size", F.coalesce("sum", "whole").alias("whole"))) if joins else parts
        left -= joins
        if joins * 100 <= left:
            return parts.select("path", "top", "lead", "back")


def lookup_parts(tree: Tree, sample: Sparse, n: int, cell_nodes: int, probes: int) -> np.ndarray:
    """Into how many groups of about ``2 * cell_nodes`` the lookups of other cells' nodes in each cell are cut, by what the sample looks up: some cells are near to very many nodes."""
    asked = np.zeros(tree.cells)
    home = tree.home(sample)
    for a in range(0, len(sample), 1024):
        rows = np.arange(a, min(a + 1024, len(sample)))
        asked += np.bincount(tree.near(sample, rows, home[rows], probes)[:, 1:].ravel(), minlength=tree.cells)
    return np.maximum(1, np.ceil(asked * n / max(len(sample), 1) / (2 * cell_nodes))).astype(np.int64)


def neighbour_graph(nodes: DataFrame, k: int = 8, cell_nodes: int = 4096, probes: int = 2) -> DataFrame:
    """(cell, nid, found) with the k nearest of each node (nid, vec), nearest first, by (distance, nid), among the cells that it is looked up in."""
    n = nodes.count()
    cells = 1
    while cells * cell_nodes < n and cells < MAX_CELLS:
        cells *= 2
    share = min(1.0, max(LEAST_SAMPLE, PER_CELL * cells) / max(n, 1))
    sample = nodes.where(F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("nid").select("vec").toPandas()["vec"] if cells > 1 else []
    rows = Sparse([bytes(v) for v in sample])
    tree = Tree(rows, cells)
    part_count = lookup_parts(tree, rows, n, cell_nodes, probes)
    first = np.append(0, np.cumsum(part_count))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = Sparse(part.column(1).to_pylist())
                home = tree.home(rows)
                cell = tree.near(rows, np.arange(len(rows)), home, probes)
                others = cell[:, 1:]
                salt = part.column(0).to_numpy()[:, None].view(U64) % part_count[others].astype(U64)
                copies = part_count[home]
                twin = np.repeat(np.arange(len(rows)), copies)
                turn = np.arange(len(twin)) - np.repeat(np.cumsum(copies) - copies, copies)
                row = np.concatenate([twin, np.repeat(np.arange(len(rows)), others.shape[1])])
                group = np.concatenate([first[home[twin]] + turn, (first[others] + salt.astype(np.int64)).ravel()])
                member = np.arange(len(row)) < len(twin)
                asks = np.append(turn == 0, np.ones(others.size, bool))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(home[row]), part.column(0).take(at), pa.array(member), pa.array(asks), part.column(1).take(at)], ["group", "cell", "nid", "member", "asks", "vec"])

    placed = nodes.select("nid", "vec").mapInArrow(place, "group long, cell long, nid long, member boolean, asks boolean, vec binary")
    # a group is a task's work, however few bytes it has, so that groups aren't put together by size
    found = placed.repartition(int(first[-1]), "group").sortWithinPartitions("group").mapInArrow(_cell_rows(k), f"cell long, nid long, found {_FOUND}")
    return found.groupBy("nid").agg(F.max("cell").alias("cell"), F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")).select("cell", "nid", "found")


def document_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, tokens, nid, vec) of every row that has tokens, in a durable table."""
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("digest"))
    rows = given.mapInArrow(_vector_rows, f"id {kind}, digest long, tokens long, vec binary").where("tokens > 0")
    return durable(rows.withColumn("nid", F.xxhash64("vec")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_tokens: int = 2048, k: int = 8, cell_nodes: int = 4096, probes: int = 2) -> DataFrame:
    """(block, window, offset, id, token_start, token_end): what each window holds, in order; see the module's text."""
    rows = document_nodes(docs, id_col, text_col)
    nodes = durable(rows.groupBy("nid").agg(F.min("vec").alias("vec")))
    graph = durable(neighbour_graph(nodes, k, cell_nodes, probes))
    walked = durable(graph.repartition("cell").sortWithinPartitions("cell").mapInArrow(_walk_rows, "cell long, nid long, path long, pos long, size long"))
    joined = join_paths(walked, graph, cell_nodes)
    place = F.col("lead") + F.when(F.col("back"), F.col("size") - 1 - F.col("pos")).otherwise(F.col("pos"))
    order = walked.join(joined, "path").select("nid", "top", place.alias("place"))
    tops = walked.where("pos = 0").select(F.col("path").alias("top"), "cell")
    order = order.join(tops, "top")
    line = Window.partitionBy("cell").orderBy("top", "place", "id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.select("id", "digest", "tokens", "nid").join(order, "nid").withColumn("stop", F.sum("tokens").over(line))
    start = F.col("stop") - F.col("tokens")
    size = F.lit(window_tokens)
    parts = laid.select("cell", "id", "stop", start.alias("start"), F.explode(F.sequence(F.floor(start / size), F.floor((F.col("stop") - 1) / size))).alias("window"))
    begin = F.greatest(F.col("start"), F.col("window") * size)
    end = F.least(F.col("stop"), (F.col("window") + 1) * size)
    block, window, offset, first, last = fresh([id_col], "block", "window", "offset", "token_start", "token_end")
    return parts.select(
        F.col("cell").alias(block), F.col("window").alias(window), (begin - F.col("window") * size).alias(offset), F.col("id").alias(id_col),
        (begin - F.col("start")).alias(first), (end - F.col("start")).alias(last),
    )
