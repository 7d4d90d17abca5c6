"""SentencePiece encoding and decoding over a relational lattice.

1. Segments. A text, with blanks for the piece mark and one put in front, is cut wherever
   no piece holds the two characters that meet; no piece can span such a cut, so segments
   are encoded alone. Every input partition lists its distinct segments.
2. Lattice. The bounded-length substrings of every distinct segment are exploded and
   equi-joined to the piece table, whose size is the model's and checked; the edges that
   result are grouped by segment, which needs no second shuffle.
3. Fold. A Spark ``aggregate`` goes over the edges by their ends. For a unigram model it is
   Viterbi: the best sum of scores at each end. For a BPE model it keeps, at each end, the
   one edge that byte-pair merging would leave there: an edge may follow another if no
   piece across their boundary would have been merged while both of its parts were still
   whole, which the pieces' outer parts and the ranks at which these are merged away tell.
   The ids are those of the reference library, not those of a best sum over ranks.
4. Documents. The encoded segments are joined to the partitions' lists and written to the
   shared folder by partition. The texts are read again and never shuffled; a task reads
   the ids of its own partition's segments, which are as many as its input holds, however
   large the corpus. Should a partition's rows have changed between the two readings, the
   segments that its list lacks are folded in place, so the ids are right in any case.

The copying that ``aggregate`` does is quadratic in a segment's length, so distinct segments
of more than ``LONG`` characters are folded in Python, each once, which is linear.
Characters without a piece become byte pieces or the unknown piece.

Defined results
---------------
* null texts: null ids; empty texts: no ids. Texts of any length are encoded whole.
* equal texts get equal ids; rows that repeat are all kept; null ids of documents don't matter.
* decoding gives the text back, but for the piece mark itself, which becomes a blank; ids that the model lacks and control pieces give nothing; broken byte sequences give U+FFFD.
* other columns pass through; new columns get leading underscores if their names are taken. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import as_strings, byte_view, slices
from .common import col, durable, file_system, forget, fresh, made, mark, require, shared_dir

MARK, LONG, NEVER, SHIFT = "▁", 128, (1 << 24) - 1, 24
MAX_BROADCAST_PIECES, SIZES = 1_000_000, 127
#: Bytes of text that are cut into segments at a time; distinct segments that a task holds before it passes them on.
SLICE, HELD = 1 << 21, 1 << 19


@dataclass
class Pieces:
    """A model: texts with blanks for marks, ids, scores, and what else encoding needs."""

    kind: str
    texts: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int] | None
    unknown: int
    size: int
    prefix: bool = True
    special: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.texts))
        self.row = {t: i for i, t in enumerate(self.texts)}
        self.rank = np.unique(-np.array(self.scores), return_inverse=True)[1].ravel().tolist()
        spines = [_spines(t, self) if self.kind == "bpe" else ([], []) for t in self.texts]
        whole = [i for i, s in enumerate(spines) if s is not None]  # pieces that merging can reach
        self.row = {self.texts[i]: n for n, i in enumerate(whole)}
        for name in ("texts", "ids", "scores", "rank"):
            setattr(self, name, [getattr(self, name)[i] for i in whole])
        spines = [spines[i] for i in whole] + [([NEVER], [NEVER])]  # the last row is a character without a piece
        self.offset = np.append(0, np.cumsum([len(s[0]) for s in spines]))[:-1].tolist()
        self.right, self.left = ([x for s in spines for x in s[side]] for side in (0, 1))
        self.scores.append(min(self.scores) - 10)
        self.rank.append(NEVER)
        table = np.zeros((256, 256), bool)
        for t in self.texts:
            for a, b in zip(t, t[1:]):
                table[a.encode()[-1], b.encode()[0]] = True
        self.meets = table

    @staticmethod
    def load(path: str) -> Pieces:
        """From a SentencePiece model file without a character map."""
        import sentencepiece

        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        normal = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("models that map characters or drop blanks are not supported")
        s = sentencepiece.SentencePieceProcessor(model_file=path)
        n = s.get_piece_size()
        plain = [i for i in range(n) if not (s.is_byte(i) or s.is_control(i) or s.is_unknown(i) or s.is_unused(i))]
        of_byte = {int(s.id_to_piece(i)[3:5], 16): i for i in range(n) if s.is_byte(i)}
        kind = {1: "unigram", 2: "bpe"}[trainer.get(3, 1)]
        special = frozenset(i for i in range(n) if s.is_control(i))
        return Pieces(kind, [s.id_to_piece(i).replace(MARK, " ") for i in plain], plain, [s.get_score(i) for i in plain], [of_byte[b] for b in range(256)] if of_byte else None, s.unk_id(), n, bool(normal.get(3, 1)), special)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def _spines(piece: str, p: Pieces) -> tuple[list[int], list[int]] | None:
    """For its outermost right and left parts, by length, the rank of the merge that ends them (0: no such part); None if merging doesn't give the piece."""
    parts = list(piece)
    right, left = [0] * len(piece), [0] * len(piece)
    while len(parts) > 1:
        ranked = [(p.rank[p.row[x + y]] + 1, i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in p.row]
        if not ranked:
            return None
        r, i = min(ranked)
        if i == len(parts) - 2:
            right[len(parts[-1]) - 1] = r
        if i == 0:
            left[len(parts[0]) - 1] = r
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    right[-1] = left[-1] = NEVER
    return right, left


def segments(texts: pa.Array, p: Pieces) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts and the n+1 offsets of the texts' segments among them."""
    texts = pc.replace_substring(as_strings(texts), MARK, " ")
    if p.prefix:
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
    data, off = byte_view(texts)
    cut = np.zeros(len(data), bool)
    for a in range(1, len(data), 1 << 19):  # indices take eight bytes a character
        b = min(a + (1 << 19), len(data))
        cut[a:b] = ~p.meets[data[a - 1 : b - 1], data[a:b]] & ((data[a:b] & 0xC0) != 0x80)
    cut[off[:-1][off[:-1] < off[1:]]] = True
    start = np.flatnonzero(cut)
    ends = np.append(start, len(data)).astype(np.int32)
    out = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return out, np.searchsorted(start, off)


def encode_segment(text: str, p: Pieces) -> list[int]:
    """Ids of one segment; linear in its length."""
    none = len(p.texts)
    last: list[tuple[int, int]] = [(0, none)]  # start and row of the edge kept at each end
    best = [0.0]
    for e in range(1, len(text) + 1):
        kept, top = None, 0.0
        for s in range(max(0, e - p.longest), e):
            row = p.row.get(text[s:e], none if e - s == 1 else None)
            if row is None:
                continue
            if p.kind == "bpe":
                if kept is None and (s == 0 or _may_follow(text, last[s], s, row, e, p)):
                    kept = (s, row)
            elif kept is None or best[s] + p.scores[row] > top:
                kept, top = (s, row), best[s] + p.scores[row]
        last.append(kept)
        best.append(top)
    out: list[int] = []
    e = len(text)
    while e:
        s, row = last[e]
        out += reversed(_ids_of(text[s:e], row, p))
        e = s
    return out[::-1]


def _may_follow(text: str, before: tuple[int, int], s: int, row: int, e: int, p: Pieces) -> bool:
    a, b = p.offset[before[1]], p.offset[row]
    for x in range(before[0], s):
        dies = p.right[a + s - x - 1]
        for y in range(s + 1, e + 1):
            across = p.row.get(text[x:y])
            if across is not None and p.rank[across] + 1 < dies and p.rank[across] + 1 <= p.left[b + y - s - 1]:
                return False
    return True


def _ids_of(text: str, row: int, p: Pieces) -> list[int]:
    if row < len(p.texts):
        return [p.ids[row]]
    return [p.byte_ids[b] for b in text.encode()] if p.byte_ids else [p.unknown]


def _constant(values: list, kind: str) -> Column:
    """A constant array, made from one string when the plan is folded."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def edge_table(words: DataFrame, p: Pieces) -> DataFrame:
    """(segment, edges): the lattice of every distinct segment as packed numbers that sort by end, then start."""
    spark = words.sparkSession
    if len(p.texts) > MAX_BROADCAST_PIECES or p.longest > SIZES:
        raise ValueError(f"{len(p.texts)} pieces of up to {p.longest} characters are too many or too long")
    table = spark.createDataFrame(pa.table({"piece": pa.array(p.texts), "row": pa.array(range(len(p.texts)), pa.int32())}).to_pandas(), "piece string, row int")
    words = words.select(F.monotonically_increasing_id().alias("at"), "segment", F.length("segment").alias("size"))  # edges come in the order of numbers, not of segments: grouping finds them sorted
    starts = words.select("at", "segment", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("s"))
    subs = starts.select("at", "segment", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest), F.col("size") - F.col("s")))).alias("k"))
    subs = subs.select("at", "segment", "s", "k", F.expr("substring(segment, s + 1, k)").alias("piece"))
    hits = subs.join(F.broadcast(table), "piece", "left").where("row IS NOT NULL OR k = 1")
    end, back = (F.col("s") + F.col("k")).cast("long"), (SIZES - F.col("k")).cast("long")
    packed = F.shiftleft(end, SHIFT + 7) + F.shiftleft(back, SHIFT) + F.coalesce("row", F.lit(len(p.texts))).cast("long")
    return hits.groupBy("at", "segment").agg(F.collect_list(packed).alias("edges")).drop("at")


def fold_edges(p: Pieces) -> Column:
    """Ids of a segment from its packed ``edges``."""
    offset, right, left, rank = (_constant(v, "int") for v in (p.offset, p.right, p.left, [min(r + 1, NEVER) for r in p.rank]))

    def unpack(x: Column) -> Column:
        row = x.bitwiseAND(F.lit(NEVER)).cast("int")
        e = F.shiftright(x, SHIFT + 7).cast("int")
        s = e - SIZES + F.shiftright(x, SHIFT).bitwiseAND(F.lit(SIZES)).cast("int")
        return F.struct(e.alias("e"), s.alias("s"), row.alias("row"), F.get(rank, row).alias("r"), F.get(offset, row).alias("o"))

    def path(edges: Column) -> Column:
        if p.kind == "bpe":
            many = F.filter(edges, lambda x: x["e"] - x["s"] > 1)
            return F.transform(F.array(many), lambda m: _fold_bpe(edges, m, right, left))[0]
        return _fold_viterbi(edges, _constant(p.scores, "double"))

    def trace(kept: Column) -> Column:
        end = F.size(kept) - 1
        start = F.struct(end.alias("at"), F.array().cast("array<struct<s:int,e:int,row:int>>").alias("out"))

        def back(acc: Column, _: Column) -> Column:
            edge = F.get(kept, acc["at"])
            one = F.array(F.struct(edge["s"].alias("s"), acc["at"].alias("e"), edge["row"].alias("row")))
            return F.when(acc["at"] > 0, F.struct(edge["s"].alias("at"), F.concat(one, acc["out"]).alias("out"))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), end), start, back, lambda acc: acc["out"])

    ids = _constant([*p.ids, -1], "int")
    bytes_ = _constant(p.byte_ids, "int") if p.byte_ids else None

    def emit(x: Column) -> Column:
        known = F.array(F.get(ids, x["row"]))
        if bytes_ is None:
            return F.when(x["row"] < len(p.texts), known).otherwise(F.array(F.lit(p.unknown)))
        digits = F.hex(F.encode(F.substring(F.col("segment"), x["s"] + 1, F.lit(1)), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.get(bytes_, F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(x["row"] < len(p.texts), known).otherwise(raw)

    edges = F.transform(F.sort_array("edges"), unpack)  # array_sort would interpret a comparison in SQL
    kept = F.transform(F.array(edges), path)[0]
    return F.flatten(F.transform(F.transform(F.array(kept), trace)[0], emit))


_EDGE = "array<struct<e:int,s:int,row:int,r:int,o:int>>"


def _fold_bpe(edges: Column, many: Column, right: Column, left: Column) -> Column:
    """The edge that is kept at each end, by end; index 0 is the empty beginning."""

    def step(kept: Column, b: Column) -> Column:
        at = b["s"]

        def crosses(x: Column) -> Column:
            before = F.get(kept, at)
            return (
                (x["s"] < at) & (x["e"] > at) & (x["e"] <= b["e"]) & (x["r"] <= F.get(left, b["o"] + x["e"] - at - 1))
                & (x["s"] >= before["s"]) & (x["r"] < F.get(right, before["o"] + at - x["s"] - 1))
            )

        fits = (F.size(kept) == b["e"]) & ((b["s"] == 0) | ~F.exists(many, crosses))
        return F.when(fits, F.concat(kept, F.array(b))).otherwise(kept)

    first = F.array(F.struct(*[F.lit(0).alias(c) for c in ("e", "s", "row", "r", "o")])).cast(_EDGE)
    return F.aggregate(edges, first, step)


def _fold_viterbi(edges: Column, scores: Column) -> Column:
    """The best edge at each end; of equal ones the longest."""

    def step(kept: Column, b: Column) -> Column:
        total = F.get(kept, b["s"])["score"] + F.get(scores, b["row"])
        new = F.array(F.struct(b["e"].alias("e"), b["s"].alias("s"), b["row"].alias("row"), total.alias("score")))
        return F.when(F.size(kept) == b["e"], F.concat(kept, new)).when(total > F.get(kept, b["e"])["score"], F.concat(F.slice(kept, F.lit(1), b["e"]), new)).otherwise(kept)

    first = F.array(F.struct(*[F.lit(0).alias(c) for c in ("e", "s", "row")], F.lit(0.0).alias("score"))).cast("array<struct<e:int,s:int,row:int,score:double>>")
    return F.aggregate(edges, first, step)


def id_bytes(p: Pieces) -> int:
    """Bytes of an id where many are kept."""
    return 2 if p.size <= 1 << 16 else 4


def encode_segments(words: DataFrame, p: Pieces) -> DataFrame:
    """(segment, ids) of distinct segments, the ids as bytes, the highest first."""
    width = id_bytes(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                one = batch.column(0).slice(x, 1)
                yield pa.RecordBatch.from_arrays([one, pa.array([np.array(encode_segment(one[0].as_py(), p), f">u{width}").tobytes()], pa.binary())], ["segment", "ids"])

    digits = F.transform(fold_edges(p), lambda x: F.lpad(F.hex(x), 2 * width, "0"))
    short = edge_table(words.where(F.length("segment") <= LONG), p).select("segment", F.unhex(F.array_join(digits, "")).alias("ids"))
    return short.unionByName(words.where(F.length("segment") > LONG).mapInArrow(run, "segment string, ids binary"))


def part_segments(docs: DataFrame, text_col: str, p: Pieces) -> DataFrame:
    """(part, segment): the distinct segments of every input partition. What a task holds is bounded; a partition with very many segments may list one twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(found: pa.Array) -> Iterator[pa.RecordBatch]:
            found = found.take(pc.sort_indices(found))  # packs more tightly
            for x in range(0, len(found), 1 << 16):
                some = found.slice(x, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), some], ["part", "segment"])

        held = [pa.array([], pa.string())]
        for batch in batches:
            texts = as_strings(batch.column(0))
            for a, b in slices(texts, SLICE, 1 << 20):
                held.append(pc.unique(segments(texts.slice(a, b - a), p)[0]))
                if sum(map(len, held)) > HELD:
                    held = [pc.unique(pa.concat_arrays(held))]
                    if len(held[0]) > HELD // 2:
                        yield from rows(held[0])
                        held = [held[0].slice(0, 0)]
        yield from rows(pc.unique(pa.concat_arrays(held)))
        del held
        pa.default_memory_pool().release_unused()

    return docs.where(col(text_col).isNotNull()).select(col(text_col)).mapInArrow(run, "part int, segment string")


def _own_ids(folder: str, kind: type) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(segments, ids one after another, where each begins, how many it has) of one partition's folder; nothing if there is none."""
    fs, root = file_system(folder)
    words, flat, size = [pa.array([], pa.string())], [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as opened:
                part = pq.ParquetFile(opened).read(["segment", "ids"], use_threads=False)
            words += part.column("segment").cast(pa.string()).chunks
            for ids in part.column("ids").cast(pa.binary()).chunks:
                data, off = byte_view(ids)
                flat.append(data.view(np.dtype(kind).newbyteorder(">")).astype(kind))
                size.append(np.diff(off) // np.dtype(kind).itemsize)
            del part
    size = np.concatenate(size)
    return pa.concat_arrays(words), np.concatenate(flat), np.cumsum(size) - size, size


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, and with their texts again in ``decoded`` if that is named; see the module's text."""
    require(docs, text_col)
    ids_col, decoded = fresh(docs, "ids", decoded) if decoded else (*fresh(docs, "ids"), None)
    since = mark()
    pairs = durable(part_segments(docs, text_col, pieces), "zstd")
    tasks = min(max(pairs.count() >> 17, 1), 100_000)  # lattices are far larger than the segments that they come from
    # from here on a segment is one row, with its partitions as a list
    parts = durable(pairs.repartition(tasks, "segment").groupBy("segment").agg(F.collect_list("part").alias("parts")), "zstd")
    forget(docs.sparkSession, since, keep=1)
    table = durable(encode_segments(parts.select("segment").repartition(tasks, "segment"), pieces), "zstd")
    path = made(f"{shared_dir(docs.sparkSession)}/pieces-{uuid.uuid4().hex}")
    coded = parts.join(table, "segment").select(F.explode("parts").alias("part"), "segment", "ids")
    coded.repartition("part").sortWithinPartitions("part", "segment").write.partitionBy("part").parquet(path, compression="zstd")
    at = docs.columns.index(text_col)
    kept_at = [i for i, c in enumerate(docs.columns) if keep_text or c != text_col]
    fields = [*[docs.schema.fields[i] for i in kept_at], T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if id_bytes(pieces) == 2 else np.uint32
        words, flat, begin, size = _own_ids(f"{path}/part={TaskContext.get().partitionId()}", kind)
        pa.default_memory_pool().release_unused()
        back = piece_bytes(pieces) if decoded else None
        for batch in batches:
            texts = as_strings(batch.column(at))
            for a, b in slices(texts, SLICE, 1 << 20):
                part, off = segments(texts.slice(a, b - a), pieces)
                coded = part.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy().astype(np.int64)
                new = np.flatnonzero(known < 0)
                own_begin, own_size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
                own_begin[known >= 0], own_size[known >= 0] = begin[known[known >= 0]], size[known[known >= 0]]
                pool = flat
                if len(new):
                    extra = [encode_segment(w, pieces) for w in coded.dictionary.take(pa.array(new)).to_pylist()]
                    own_size[new] = [len(x) for x in extra]
                    own_begin[new] = len(flat) + np.cumsum(own_size[new]) - own_size[new]
                    pool = np.concatenate([flat, np.array([i for x in extra for i in x], kind)])
                index = coded.indices.to_numpy()
                for c, d in slices(texts.slice(a, b - a), SLICE // 8, 1 << 20):
                    own = index[off[c] : off[d]]
                    n = own_size[own]
                    ends = np.append(0, np.cumsum(n))
                    put = pool[np.arange(ends[-1]) - np.repeat(ends[:-1] - own_begin[own], n)].astype(np.int32)
                    got = pa.ListArray.from_arrays(pa.array(ends[off[c : d + 1] - off[c]], pa.int32()), pa.array(put, pa.int32()))
                    rows = batch.slice(a + c, d - c)
                    got = pc.if_else(pc.is_null(rows.column(at)), pa.scalar(None, got.type), got)
                    yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in kept_at], got, *([texts_of(got, back, pieces.prefix)] if back else [])], names)

    return docs.mapInArrow(run, T.StructType(fields))


def piece_bytes(p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, and where each begins and how long it is."""
    raw = [b""] * p.size
    for text, i in zip(p.texts, p.ids):
        raw[i] = text.encode()
    for b, i in enumerate(p.byte_ids or []):
        raw[i] = bytes([b])
    if not p.byte_ids:
        raw[p.unknown] = " ⁇ ".encode()
    size = np.array([len(x) for x in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(size))[:-1], size


def texts_of(lists: pa.ListArray, table: tuple[np.ndarray, np.ndarray, np.ndarray], prefix: bool) -> pa.Array:
    data, begin, size = table
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    fine = (ids >= 0) & (ids < len(size))
    ids = np.where(fine, ids, 0)
    n = np.where(fine, size[ids], 0)
    ends = np.append(0, np.cumsum(n))
    flat = data[np.arange(ends[-1]) + np.repeat(begin[ids] - ends[:-1], n)].tobytes()
    edge = ends[np.append(0, np.cumsum(counts))].tolist()
    whole = [flat[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]
    return pa.array([None if not v else t[1:] if prefix and t[:1] == " " else t for v, t in zip(pc.is_valid(lists).to_pylist(), whole)], pa.string())


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the texts of ``ids``."""
    require(rows, ids_col)
    out = fresh(rows, out)[0]
    at, names = rows.columns.index(ids_col), [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(pieces)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, texts_of(part.column(at), table, pieces.prefix)], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
