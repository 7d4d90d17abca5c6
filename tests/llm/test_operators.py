"""Each operator on odd rows, on nothing, and against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import chaining, common, langid, packing, quality, simhash, topk, warc
from siftline.llm.exact_dedup import exact_dedup
from siftline.llm.line_dedup import line_dedup

from .conftest import words


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- exact dedup ---------------------------------------------------------------------------------


def test_exact_dedup_odd_rows(odd):
    out = exact_dedup(odd)
    assert out.columns == [*odd.columns, "_copies"]
    best = defaultdict(list)
    for r in odd.collect():
        best[r.text].append(r.doc_id)
    want = Counter((min((i is None, i or 0) for i in ids)[1] if any(i is not None for i in ids) else None, t, len(ids)) for t, ids in best.items())
    assert bag(out, "doc_id", "text", "_copies") == want


def test_exact_dedup_hot_text_and_empty(make, empty):
    out = exact_dedup(make([(i, "hot") for i in range(500)] + [(900, "cold")])).collect()
    assert sorted((r.doc_id, r._copies) for r in out) == [(0, 500), (900, 1)]
    assert exact_dedup(empty).count() == 0


# --- line dedup ----------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        lines = rows[i][1].split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        kept = [x for p, x in enumerate(lines) if p not in gone]
        if kept:
            out.append((rows[i][0], "\n".join(kept)))
    return Counter(out)


def test_line_dedup_matches_brute_force(make):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d e", ""]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    assert bag(line_dedup(make(rows)), "doc_id", "text") == brute_lines(rows)


def test_line_dedup_odd_rows(odd, empty):
    out = line_dedup(odd, length_col="n_chars").collect()
    assert line_dedup(empty).count() == 0
    texts = [r.text for r in out if r.doc_id == 4]
    assert len([t for t in texts if t and t.startswith("one")]) == 2 and len(set(texts)) == 2  # rows that repeat a document are treated alike
    assert {r.doc_id for r in out if r.text is None} == {1, None} and all(r.n_chars == len(r.text) for r in out if r.text is not None)


# --- SimHash -------------------------------------------------------------------------------------


def test_gray_rank_is_a_bijection():
    codes = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.uint8)
    ranks = simhash.gray_rank(codes)
    assert (simhash.from_rank(ranks) == codes).all()
    order = np.lexsort(ranks.T[::-1])
    assert ((codes[order][1:] != codes[order][:-1]).sum(axis=1) == 1).all()


def test_hierarchy_finds_what_brute_force_finds():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    code = np.repeat(base, 6, axis=0)
    for r in range(len(code)):
        for b in rng.integers(0, 256, rng.integers(0, 40)):
            code[r, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rank = simhash.gray_rank(np.unpackbits(code.view(np.uint8), axis=1))
    bucket = rng.integers(0, 3, len(code))
    order = np.lexsort([*rank.T[::-1], bucket])
    code, bucket = code[order], bucket[order]
    d = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    for limit in (20, 44, 90):
        i, j = np.nonzero((bucket[:, None] == bucket[None]) & (d <= limit))
        assert (simhash.near_roots(bucket, code, limit) == simhash.local_roots(len(code), i, j)).all()


def test_a_bucket_of_near_copies_is_linear():
    import resource
    import time

    rng = np.random.default_rng(3)
    bits = np.tile(rng.integers(0, 2, 256, dtype=np.uint8), (50_000, 1))
    bits[np.repeat(np.arange(50_000), 20), rng.integers(0, 256, 1_000_000)] ^= 1
    rank = simhash.gray_rank(bits)
    order = np.lexsort(rank.T[::-1])
    code = np.packbits(bits[order], axis=1).view(np.uint64)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    root = simhash.near_roots(np.zeros(50_000, np.int64), code, 44)
    assert (root == 0).mean() > 0.99 and time.time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000


def test_lone_pairs_at_the_limit_are_found():
    """Pairs at distances 37 to 44 meet in a table as often as the plan says, at several sizes."""
    rng = np.random.default_rng(4)
    for nodes in (1000, 300_000, 10**10):
        tables, key_bits = simhash.bucket_plan(nodes, 44)
        picks = simhash.table_bits(tables, key_bits)
        for d in (37, 44):
            flips = np.zeros((1000, 256), bool)
            for f in flips:
                f[rng.permutation(256)[:d]] = True
            assert (~flips[:, picks].any(axis=2)).any(axis=1).mean() >= 0.975


def near_copy(rng, ws, share):
    return [rng.choice(ws) + "q" if rng.random() < share else w for w in ws]


def test_simhash_dedup_recall_and_precision(make):
    rng = random.Random(7)
    rows, group = [], {}
    for g in range(40):
        base = words(rng, 120)
        for c in range(3 if g % 2 else 1):
            group[len(rows)] = g
            rows.append((len(rows), " ".join(near_copy(rng, base, 0.03) if c else base)))
    kept = {r.doc_id for r in simhash.simhash_dedup(make(rows)).collect()}
    firsts = {min(d for d in group if group[d] == g) for g in set(group.values())}
    assert firsts <= kept and len(kept - firsts) <= 4


def test_simhash_search_equals_all_pairs(make):
    rng = random.Random(8)
    rows = [(i, " ".join(near_copy(rng, words(random.Random(i // 4), 60), 0.05))) for i in range(120)]
    bits, _ = simhash.fingerprints(pa.array([r[1] for r in rows]))
    d = (bits[:, None] != bits[None]).sum(axis=2)
    groups = {r.id: r.grp for r in simhash.simhash_groups(make(rows)).collect()}
    close = [(a, b) for a in range(120) for b in range(a) if d[a, b] <= 44]
    assert sum(groups[a] == groups[b] for a, b in close) >= 0.99 * len(close)


def test_simhash_odd_rows(odd, empty):
    out = simhash.simhash_dedup(odd)
    assert out.columns == odd.columns and simhash.simhash_dedup(empty).count() == 0
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert {(1, None), (2, ""), (3, "   \n\n"), (None, None), (6, "!!!")} <= set(got)
    assert sum(t is not None and t.startswith("one") for _, t in got) == 1


# --- chaining ------------------------------------------------------------------------------------


def brute_chain(i, j, m, gap):
    n, best = len(i), 0.0
    order = sorted(range(n), key=lambda s: i[s])
    score = [0.0] * n
    for s in order:
        score[s] = m[s]
        for r in order:
            if i[r] + m[r] <= i[s] and j[r] + m[r] <= j[s]:
                score[s] = max(score[s], score[r] + m[s] - gap * (i[s] - i[r] - m[r] + j[s] - j[r] - m[r]))
        best = max(best, score[s])
    return best


def test_fenwick_chain_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        i, j, m = ([rng.randint(0, 40) for _ in range(n)] for _ in range(3))
        m = [x % 6 + 1 for x in m]
        first = chaining.chain(i, j, m, 0.25)[0]
        got = sum(m[s] for s in first) - 0.25 * sum(i[b] - i[a] - m[a] + j[b] - j[a] - m[a] for a, b in zip(first, first[1:]))
        assert got == pytest.approx(brute_chain(i, j, m, 0.25))


def test_planted_passages_are_found_and_removed(make):
    rng = random.Random(4)
    passage = words(rng, 80)
    rows, planted = [(0, " ".join(words(rng, 40) + passage + words(rng, 40)))], []
    for d in range(1, 30):
        own = words(rng, 120)
        if d % 3 == 0:
            fuzzy = near_copy(rng, passage, 0.02) if d % 2 else passage
            own[50:50] = fuzzy
            planted.append(d)
        rows.append((d, " ".join(own)))
    docs = make(rows)
    found = chaining.repeated_passages(docs)
    got = {r.id: r for r in found.collect()}
    assert set(got) == set(planted)
    assert all(r.word_end - r.word_start >= 70 for r in got.values())
    left = {r.doc_id: r.text for r in chaining.remove_passages(docs, found, length_col="n_chars").collect()}
    assert all(len(left[d].split()) <= 132 for d in planted) and all(left[d] == t for d, t in rows if d not in planted)


def test_chains_that_fail_as_a_whole_are_reported_in_parts(make):
    rng = random.Random(41)
    p1, p2, own = words(rng, 60), words(rng, 60), lambda n: words(rng, n)
    docs = make([(0, " ".join(own(40) + p1 + own(100) + p2 + own(40))), (1, " ".join(own(40) + p1 + p2 + own(40)))])
    got = sorted((r.word_start, r.word_end, r.other_word_start, r.other_word_end) for r in chaining.repeated_passages(docs).collect())
    assert got == [(40, 100, 40, 100), (100, 160, 200, 260)]
    hit = np.array([True] * 60 + [False] * 30 + [True] * 55 + [False] * 20 + [True] * 10)
    place = np.arange(len(hit))
    assert sorted(chaining.stretches(place, place + 7, hit, 50, 0.8)) == [(0, 60, 7, 67, 60), (90, 145, 97, 152, 55)]


def test_short_fuzzy_passages_are_found(make):
    rng, rows, kind = random.Random(42), [], {}
    for n, size in enumerate((55, 60, 80)):
        for share in (0.8, 0.85, 0.9, 0.95, 1.0):
            for _ in range(40):
                passage = words(rng, size)
                edited = list(passage)
                for at in rng.sample(range(size), int(size * (1 - share) + 1e-9)):
                    edited[at] += "q"
                kind[len(rows) + 1] = (size, share)
                rows += [(len(rows) + x, " ".join(words(rng, 40) + p + words(rng, 40))) for x, p in enumerate((passage, edited))]
    found = {r.id for r in chaining.repeated_passages(make(rows)).collect()}
    recall = {c: sum(i in found for i, x in kind.items() if x == c) / 40 for c in kind.values()}
    assert found <= set(kind) and all(r >= (0.9 if c != (55, 0.8) else 0.75) for c, r in recall.items()), recall


def test_pieces_elsewhere_hide_no_passage(make):
    rng = random.Random(43)
    passage, rows = words(rng, 120), []
    piece = lambda: [(len(rows) + n, " ".join(words(rng, 30) + passage[4 * n : 4 * n + 24] + words(rng, 30))) for n in range(25)]
    rows += piece()
    one = len(rows)
    rows.append((one, " ".join(words(rng, 30) + passage + words(rng, 30))))
    rows += piece()
    two = len(rows)
    rows.append((two, " ".join(words(rng, 30) + passage + words(rng, 30))))
    found = [r for r in chaining.repeated_passages(make(rows)).collect()]
    assert [(r.id, r.other_id, r.word_start, r.word_end) for r in found] == [(two, one, 30, 150)]


def test_matches_are_gone_before_texts_are_shuffled(make, spark):
    rng = random.Random(14)
    shared = " ".join(words(rng, 80))
    before = common.mark()
    found = chaining.repeated_passages(make([(i, " ".join(words(rng, 20)) + " " + shared) for i in range(3)]))
    left = common._made[before:]
    assert len(left) == 1 and "chain" in spark.read.parquet(left[0]).columns
    assert sorted((r.id, r.other_id) for r in found.collect()) == [(1, 0), (2, 0)]


def test_verbatim_passages_equal_all_pairs(make):
    """Documents patched together from stretches of a few texts: words that lie in 50 words which an earlier document has are reported, but for a few at ends, and hardly others."""
    rng = random.Random(44)
    base = [words(rng, 400) for _ in range(6)]
    rows = []
    for d in range(80):
        own: list = []
        for _ in range(rng.randint(1, 3)):
            own += words(rng, rng.randint(5, 40))
            text, n = rng.choice(base), rng.choice([20, 30, 45, 60, 90, 150])
            at = rng.randint(0, 400 - n)
            own += text[at : at + n]
        rows.append((d, " ".join(own)))
    split = [t.split() for _, t in rows]
    seen, want = set(), set()
    for d, ws in enumerate(split):
        grams = [tuple(ws[i : i + 50]) for i in range(len(ws) - 49)]
        want |= {(d, i + x) for i, g in enumerate(grams) if g in seen for x in range(50)}
        seen |= set(grams)
    got = {(r.id, w) for r in chaining.repeated_passages(make(rows), min_identity=0.95).collect() for w in range(r.word_start, r.word_end)}
    assert len(want) > 3000 and len(want - got) < 0.002 * len(want) and {d for d, _ in want} <= {d for d, _ in got} and len(got - want) < 0.1 * len(want)


def test_one_id_with_two_texts_and_repeated_rows(make):
    rng = random.Random(45)
    passage = words(rng, 70)
    texts = [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(3)]
    docs = make([(1, texts[0]), (1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2])])
    left = chaining.remove_passages(docs, chaining.repeated_passages(docs)).collect()
    assert len(left) == 5 and Counter(len(r.text.split()) for r in left if r.doc_id == 1) == {110: 2}
    assert all(len(r.text.split()) == 40 for r in left if r.doc_id == 2)


def test_contexts_and_their_filter():
    text = pa.array(["a b c d e f g h", " ".join(f"w{i}" for i in range(100)), ""])
    ws = chaining.Words(text)
    at = np.array([0, 3, 8, 40, 102])
    got = chaining.contexts(ws, at, 2)
    bit = ((ws.hash >> np.uint64(20)) & np.uint64(1)).tolist()
    for p, c in zip(at.tolist(), got.tolist()):
        a, b = (0, 8) if p < 8 else (8, 108)
        behind = sum(bit[p + 2 + j] << j for j in range(32) if p + 2 + j < b)
        before = sum(bit[p - 1 - j] << (31 - j) for j in range(32) if p - 1 - j >= a)
        assert c == behind | before << 32
    rng = np.random.default_rng(46)
    one = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    two = one.copy()
    for n in range(3000):
        x = int(rng.integers(0, 45))  # 44 words around a seed, a fifth of 50 differ
        bits = [32 + 31 - j for j in range(x)][:32] + list(range(min(32, 44 - x)))
        for b in rng.permutation(np.arange(44))[:10]:
            if b < len(bits) and rng.random() < 0.5:
                two[n] ^= np.uint64(1) << np.uint64(bits[b])
    assert chaining.alike(one, two).mean() > 0.99
    assert chaining.alike(one, rng.permutation(one)).mean() < 0.04


def test_chaining_odd_rows(odd, empty):
    assert chaining.repeated_passages(empty).count() == 0
    out = chaining.remove_passages(odd, chaining.repeated_passages(odd))
    assert out.columns == odd.columns and {r.doc_id for r in out.collect() if r.text is None} == {1, None}


# --- packing -------------------------------------------------------------------------------------


def check_windows(rows, out, size):
    tokens = {}
    for i, t in rows:
        tokens[i] = tokens.get(i, 0) + len((t or "").split())
    covered = defaultdict(list)
    fill = defaultdict(int)
    for r in out:
        covered[r.doc_id].append((r.token_start, r.token_end))
        fill[r.block, r.window] += r.token_end - r.token_start
    for i, n in tokens.items():
        assert sum(b - a for a, b in covered.get(i, [])) == n
    for block in {b for b, _ in fill}:
        last = max(w for b, w in fill if b == block)
        assert all(fill[block, w] == size for w in range(last)) and fill[block, last] <= size


def test_packing_fills_windows(make):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(0, 90)))) for i in range(80)]
    check_windows(rows, packing.pack(make(rows), window_tokens=64, k=4, cell_nodes=16).collect(), 64)


def brute_neighbours(rows, k):
    x = packing.Sparse([bytes(r.vec) for r in rows])
    x = x.dense(np.arange(len(x))).astype(float) / x.size[:, None]
    d, ids = 1 - np.round(x @ x.T, 9), np.array([r.nid for r in rows])
    np.fill_diagonal(d, np.inf)
    return {ids[r]: [(d[r, o], ids[o]) for o in np.lexsort((ids, d[r]))[:k] if d[r, o] < 1] for r in range(len(ids))}


def test_neighbours_in_all_cells_are_exact(make):
    rng = random.Random(9)
    nodes = packing.document_nodes(make([(i, " ".join(words(rng, 30, "abcd", (1, 4)))) for i in range(300)])).select("nid", "vec")
    want = brute_neighbours(nodes.collect(), 5)
    for cells, probes in ((32, 64), (4096, 1)):
        got = {r.nid: [(x.d, x.nid) for x in r.found] for r in packing.neighbour_graph(nodes, 5, cells, probes).collect()}
        assert got.keys() == want.keys() and all([n for _, n in got[i]] == [n for _, n in want[i]] and np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]]) for i in want)


def test_recall_of_neighbours_and_even_cells(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    nodes = packing.document_nodes(docs).groupBy("nid").agg(F.min("vec").alias("vec")).cache()
    want = brute_neighbours(nodes.collect(), 8)
    for cell_nodes, least in ((4096, 0.999), (128, 0.8)):
        graph = packing.neighbour_graph(nodes, 8, cell_nodes, 4).collect()
        got = {r.nid: {x.nid for x in r.found} for r in graph}
        assert sum(len(got[i] & {n for _, n in want[i]}) for i in want) >= least * sum(map(len, want.values()))
        assert max(Counter(r.cell for r in graph).values()) <= 2 * cell_nodes
    nodes.unpersist()


def test_lookups_in_a_cell_that_many_are_near_to_are_split(make, monkeypatch):
    class Hot:
        cells = 4
        home = staticmethod(lambda rows: np.arange(len(rows)) % 3)
        near = staticmethod(lambda rows, which, home, probes: np.stack([home, np.full(len(home), 3)], axis=1))

    sample = packing.Sparse(packing.sketches(pa.array(["one two", "three"] * 50)))
    assert packing.lookup_parts(Hot, sample, 100_000, 4096, 2).tolist() == [1, 1, 1, 13]
    rng = random.Random(13)
    nodes = packing.document_nodes(make([(i, " ".join(words(rng, 30, "abcd", (1, 4)))) for i in range(200)])).select("nid", "vec")
    want = brute_neighbours(nodes.collect(), 5)
    monkeypatch.setattr(packing, "lookup_parts", lambda tree, *_: np.arange(tree.cells) % 3 + 1)
    got = {r.nid: [x.nid for x in r.found] for r in packing.neighbour_graph(nodes, 5, 32, 64).collect()}
    assert got == {i: [n for _, n in want[i]] for i in want}


@pytest.mark.parametrize("size", [5, 900])
def test_products_in_cells_of_long_texts_are_dense(size, monkeypatch):
    """Postings of numbers that most members have would take members x members products each."""
    rng = random.Random(size)
    members = packing.Sparse(packing.sketches(pa.array([" ".join(words(rng, size)) for _ in range(300)])))
    ids = np.array(rng.sample(range(1000), 300))
    cell = packing.Cell(members, ids)
    count = np.bincount(members.cell, minlength=packing.SKETCH)
    assert (count[cell.slot < 0] * packing.SELDOM <= 300).all()
    one = cell.among(8)
    monkeypatch.setattr(packing, "SQUARE", 0)
    assert all((a == b).all() for a, b in zip(one, cell.among(8)))
    x = members.dense(np.arange(300)).astype(float) / members.size[:, None]
    d = 1 - np.round(x @ x.T, 9)
    np.fill_diagonal(d, np.inf)
    d[d >= 1] = np.inf
    assert np.allclose(np.sort(d, axis=1)[:, :8], one[0])


def test_paths_are_joined_across_cells(spark):
    """A chain of nodes in four cells comes out as one path, and longer ones than allowed are not made."""
    chain = [(i % 4, i, [(0.1, i + 1)] if i < 15 else []) for i in range(16)]
    graph = spark.createDataFrame(chain, "cell long, nid long, found array<struct<d:double,nid:long>>")
    for most, least in ((100, 16), (8, 4)):
        walked = graph.repartition("cell").sortWithinPartitions("cell").mapInArrow(packing._walk_rows, "cell long, nid long, path long, pos long, size long")
        paths = packing.join_paths(walked, graph, most).collect()
        size = Counter(r.top for r in paths)
        assert least <= max(size.values()) <= most and len(paths) == 16
        if most == 100:
            order = [r.path for r in sorted(paths, key=lambda r: r.lead)]
            assert order in (list(range(16)), list(range(15, -1, -1)))


def used_edges(spark, rows, cell_nodes):
    graph = packing.neighbour_graph(rows, 8, cell_nodes, 64).persist()
    walked = graph.repartition("cell").sortWithinPartitions("cell").mapInArrow(packing._walk_rows, "cell long, nid long, path long, pos long, size long").persist()
    tops = packing.join_paths(walked, graph, 4096).select("top").distinct().count()
    return 1 - tops / rows.count()


def test_use_of_edges_does_not_hang_on_cells(spark, make):
    rng = random.Random(10)
    rows = packing.document_nodes(make([(i, " ".join(words(random.Random(i // 12), 30)[:25] + words(rng, 6))) for i in range(480)])).select("nid", "vec").persist()
    one, many = used_edges(spark, rows, 4096), used_edges(spark, rows, 16)
    assert abs(one - many) < 0.05


@pytest.mark.parametrize("name", ["window", "block", "offset", "token_end", "id", "nid"])
def test_packing_keeps_the_name_of_ids(make, name):
    out = packing.pack(make([(1, "one two three"), (2, "two three four")]).withColumnRenamed("id", "id_").withColumnRenamed("doc_id", name + "x").drop(name).withColumnRenamed(name + "x", name), id_col=name)
    assert name in out.columns and len(set(out.columns)) == 6 and {r[name] for r in out.select(name).collect()} == {1, 2}


def test_walk_visits_low_degree_first():
    path = packing.walk(np.arange(5), np.array([0, 1, 1]), np.array([1, 2, 3]), np.array([1.0, 2.0, 0.5]))
    assert path.tolist() == [4, 0, 1, 3, 2]


def test_packing_odd_rows(odd, empty):
    out = packing.pack(odd).collect()
    check_windows([(r.doc_id, r.text) for r in odd.collect()], out, 2048)
    assert packing.pack(empty).count() == 0


# --- language ------------------------------------------------------------------------------------


def test_mixtures_of_two_languages(make):
    rng = random.Random(11)
    a = lambda n: " ".join(words(rng, n, "abcde"))
    b = lambda n: " ".join(words(rng, n, "vwxyz"))
    train = [(i, a(80) if i % 2 else b(80), "aa" if i % 2 else "bb") for i in range(60)]
    model = langid.fit_languages(make(train))
    tests = [(1, a(60)), (2, b(60)), (3, a(50) + " " + b(50)), (4, " ".join(words(rng, 60, "mnopq"))), (5, "123 !!!"), (6, None)]
    out = {r.doc_id: r for r in langid.identify_languages(make(tests), model=model).collect()}
    got = {i: r["_languages"] for i, r in out.items()}
    assert got[1] == ["aa"] and got[2] == ["bb"] and set(got[3]) == {"aa", "bb"} and got[4] == ["und"] and got[5] == got[6] == []
    assert all(abs(s - 0.5) < 0.1 for s in out[3]["shares"])
    assert [out[i].accepted for i in range(1, 7)] == [True, True, True, False, False, False]


def test_em_beats_a_grid():
    rng = np.random.default_rng(12)
    p = rng.dirichlet(np.ones(langid.BINS), 2).astype(np.float32)
    counts = rng.multinomial(400, 0.3 * p[0].astype(float) / p[0].sum() + 0.7 * p[1].astype(float) / p[1].sum() if False else (lambda q: q / q.sum())(0.3 * p[0].astype(float) + 0.7 * p[1])).astype(np.float32)[None]
    share = langid._em(counts, counts.sum(axis=1), np.full((1, 2), 0.5, np.float32), p, 60)[0][0]
    like = lambda w: float((counts[0] * np.log(w * p[0] + (1 - w) * p[1])).sum())
    grid = max(np.linspace(0.01, 0.99, 99), key=like)
    assert abs(share[0] - grid) < 0.02


def test_language_odd_rows(odd, empty):
    assert langid.identify_languages(odd).count() == odd.count()
    assert langid.identify_languages(empty).count() == 0
    assert all(not r.accepted for r in langid.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).select("accepted").collect())


# --- quality -------------------------------------------------------------------------------------


def quality_rows(rng, n):
    rows = []
    for i in range(n):
        good = i % 2 == 0
        ws = words(rng, 80)
        rows.append((i, " ".join(ws).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in ws[:20] * 3), good))
    return rows


def test_quality_separates_held_out_documents(spark, make):
    rows = quality_rows(random.Random(13), 200)
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows[:100]], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.rank_quality(make([r[:2] for r in rows]), labels).collect()}
    assert sum(out[i]["_keep"] == g for i, _, g in rows[100:]) >= 95
    assert min(out[i]["_score"] for i, _, g in rows if g) > max(out[i]["_score"] for i, _, g in rows if not g)


def test_newton_step_finds_the_minimum():
    rng = np.random.default_rng(14)
    good, bad = rng.normal(0.4, 1, (50, 3)), rng.normal(0, 1, (60, 3))
    w = quality.fit_pairs(good, bad)
    draw = np.random.Generator(np.random.PCG64(3))
    n = 60 * 8
    x = good[draw.integers(0, 50, n)] - bad[draw.integers(0, 60, n)]
    loss = lambda v: np.logaddexp(0, -(x @ v)).mean() + 5e-4 * v @ v
    assert all(loss(w) <= loss(w + e) + 1e-9 for e in rng.normal(0, 0.01, (50, 3)))


def test_exact_quantile(spark):
    rng = random.Random(15)
    values = [rng.choice([0.0, 1.0, rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert quality.exact_quantile(df, "s", q, bins=7, at_most=5) == sorted(values)[min(int(q * 3000), 2999)]


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    out = quality.rank_quality(odd, labels).collect()
    assert len(out) == odd.count() and all(r["_score"] is None and not r["_keep"] for r in out if r.doc_id in (1, 2, 3, 6))
    assert quality.rank_quality(empty, labels).count() == 0
    none = quality.rank_quality(odd, labels.where("false")).collect()
    assert all(r["_keep"] == (r["_score"] is not None) for r in none)


# --- top-k ---------------------------------------------------------------------------------------


def test_nra_equals_full_sums():
    rng = np.random.default_rng(16)
    for _ in range(60):
        n, m, k = int(rng.integers(1, 400)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        total, lists = np.zeros(n, np.int64), []
        for _ in range(m):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            weights = rng.integers(1, 30, len(docs))
            total[docs] += weights
            order = np.argsort(-weights, kind="stable")
            lists.append((docs[order], weights[order]))
        rank = rng.permutation(n)
        top, score = topk.nra(lists, rank, k, block=4)
        some = np.flatnonzero(total)
        want = some[np.lexsort((rank[some], -total[some]))][:k]
        assert top.tolist() == want.tolist() and score.tolist() == total[want].tolist()


def test_search_odd_rows(spark, odd, empty):
    queries = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, ""), (3, None), (None, "zzz")], "item_id int, text string")
    out = topk.search(queries, odd, k=3).collect()
    assert Counter(r.item_id for r in out) == {1: 6} and {r.doc_id for r in out} == {4, 5}
    assert topk.search(queries, empty).count() == 0 and topk.search(queries.where("false"), odd).count() == 0


# --- WARC ----------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, type string")


def test_archives_hold_every_payload_once(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>", "x", "y") for i in range(40)] + [(1, "http://h/1", "<p>1é</p>", "x", "y"), (90, None, None, None, None), (91, "u\r\nX: y", "", None, None), (None, "http://n", "long " * 200_000, None, None)]
    out = warc.deduplicated_archive(warc.responses(pages(spark, rows))).collect()
    assert len(out) == len(rows) - 1  # one row is repeated whole
    whole = {r.digest: r for r in out if r.type == "response"}
    assert len(whole) == len({(r[2] or "") for r in rows}) and sum(r.type == "revisit" for r in out) == len(out) - len(whole)
    for r in out:
        if r.type == "revisit":
            assert r.payload is None and r.refers_to == whole[r.digest].record_id and r.refers_to_uri == whole[r.digest].url
    assert len({r.record_id for r in out}) == len(out)
    assert {bytes(r.payload) for r in whole.values()} == {(r[2] or "").encode() for r in rows}
    assert [r.url for r in out if r.source_id == "91"] == ["u%0D%0AX:%20y"]


def test_given_revisits_are_resolved(spark):
    first = warc.responses(pages(spark, [(1, "http://a", "body", None, None)]))
    digest = first.first().digest
    asked = spark.createDataFrame([("9", "revisit", "http://b", None, digest, None, "<old>", None, None), ("10", "revisit", "http://c", None, "sha1:unknown", None, "<old>", "http://o", None), ("11", "revisit", "http://d", None, None, None, None, None, None)], warc.RECORD)
    out = {r.source_id: r for r in warc.deduplicated_archive(first.unionByName(asked)).collect()}
    assert out["9"].refers_to == out["1"].record_id and out["10"].refers_to == "<old>" and out["10"].refers_to_uri == "http://o" and out["11"].refers_to is None
    assert warc.deduplicated_archive(first.where("false")).count() == 0


def test_archives_roll_over(spark):
    made = warc.write_archives(warc.resolve(warc.responses(pages(spark, [(i, "u", str(i) * 500, None, None) for i in range(50)]))).coalesce(1), warc.archive_folder(spark), max_bytes=2000)
    assert made.count() > 1 and made.agg(F.sum("records")).first()[0] == 50


def test_other_records_and_binary_payloads(spark):
    raw = bytes(range(256)) * 3 + b"\r\n\r\nrest"
    rows = [
        ("1", "response", "http://a", "2020-01-02T00:00:00Z", None, raw, None, None, None), ("2", "resource", "http://b", "2020-01-01T00:00:00Z", None, raw, None, None, None), ("3", "response", "http://c", "2020-01-01T00:00:00Z", None, raw, None, None, None),
        ("4", "request", "http://a", None, None, b"GET / HTTP/1.1\r\n\r\n", None, None, None), ("5", "request", "http://b", None, None, b"GET / HTTP/1.1\r\n\r\n", None, None, None), ("6", "metadata", "http://a", None, None, b"k: v", None, None, None),
        ("7", "metadata", "http://b", None, None, raw, None, None, None), ("8", None, "http://d", None, None, None, None, None, None), ("9", "response", "http://e", None, None, b"HTTP/1.1 inside", None, None, None),
    ]
    out = {r.source_id: r for r in warc.deduplicated_archive(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert {i: r.type for i, r in out.items()} == {"1": "revisit", "2": "resource", "3": "revisit", "4": "request", "5": "request", "6": "metadata", "7": "metadata", "8": "response", "9": "response"}
    assert all(out[r[0]].payload == r[5] for r in rows if r[0] in "245679") and out["8"].payload == b""
    assert {out[i].refers_to for i in "13"} == {out["2"].record_id} and len({r.record_id for r in out.values()}) == 9  # equal dates: the lesser id is the original


def test_folders_of_other_file_systems():
    import pyarrow.fs as pafs

    from siftline.llm.common import file_system

    assert file_system("file:/tmp/x")[1] == file_system("file:///tmp/x")[1] == "/tmp/x"
    assert file_system("dbfs:/tmp/x")[1] == "/dbfs/tmp/x"
    try:
        assert isinstance(file_system("s3a://bucket/x?region=eu-west-1")[0], pafs.S3FileSystem)
    except (ImportError, AttributeError):
        pass  # built without S3
