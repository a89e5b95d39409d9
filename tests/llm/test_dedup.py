import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from feedlake.llm import grouping, line_dedup, near_text, near_vectors
from feedlake.llm.components import components
from feedlake.llm.shingles import WordHashes, shingle_set

DOCS = "doc_id long, text string"


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_components(rows, width, num, den):
    words = WordHashes()
    sets = {i: set(shingle_set(t, width, words).tolist()) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return roots(ids, links), {i: len(s) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (3, 4), (4, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k in got} and {x for p in pairs if p[0] != p[1] for x in p} == set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(rng, n_groups, copies, words=120):
    out = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            out.append(" ".join(text))
    return out


def test_near_text_equals_brute_force(spark):
    rng = random.Random(3)
    texts = near_copies(rng, 6, 25) + near_copies(rng, 20, 1)
    rows = list(enumerate(texts))
    want, _ = brute_components(rows, 3, 85, 100)
    for region, block in ((1024, 256), (8, 8)):  # the second asks for blocks and tiles
        got = near_text.near_duplicates(spark.createDataFrame(rows, DOCS), 3, (85, 100), region=region, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_text_star(spark):
    """Copies that are near to one text but not to each other, in a group larger than a block."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for c in range(1, 60):
        text = list(base)
        for at in rng.sample(range(300), 7):
            text[at] = f"y{c}_{at}"
        rows.append((c, " ".join(text)))
    want, _ = brute_components(rows, 3, 85, 100)
    got = near_text.near_duplicates(spark.createDataFrame(rows, DOCS), 3, (85, 100), block=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(rows)


def test_large_region_sheds_no_pair(spark):
    """A small `region` finds the links of a large one where copies are near to one text only."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for c in range(1, 200):
        text = list(base)
        for at in rng.sample(range(300), 7):
            text[at] = f"y{c}_{at}"
        rows.append((c, " ".join(text)))
    want, _ = brute_components(rows, 3, 85, 100)
    got = near_text.near_duplicates(spark.createDataFrame(rows, DOCS), 3, (85, 100), region=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_text_cases(spark):
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(5, "One two THREE four"), (9, "one  two\tthree\nfour"), (3, ""), (4, None), (1, " \n "), (7, "a b"), (8, "A B"), (2, "a c"), (None, "one two three four"), (None, None), (10, long), (11, long + " end"), (5, "One two THREE four"), (2**60 + 1, "q")]
    df = spark.createDataFrame([(i, t, t, "s") for i, t in rows], "doc_id long, text string, component_id string, n_shingles string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_text.near_duplicates(df, 3, (85, 100)).collect())
    n = len(set(zip(long.split(), long.split()[1:], long.split()[2:], strict=False)))
    want = [(5, 2, 5, True), (9, 2, 5, False), (3, 0, 3, True), (4, 0, 4, True), (1, 0, 1, True), (7, 1, 7, True), (8, 1, 7, False), (2, 1, 2, True), (None, 2, None, False), (None, 0, None, False), (10, n, 10, True), (11, n + 1, 10, False), (5, 2, 5, True), (2**60 + 1, 1, 2**60 + 1, True)]
    assert got == collections.Counter(want)
    assert near_text.near_duplicates(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=8))
def test_intersections(lists):
    sets = [np.unique(np.array(x, np.int64)) for x in lists]
    got = near_text._intersections(sets[:1], sets[1:])
    assert got.tolist() == [[len(set(sets[0]) & set(x)) for x in sets[1:]]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**20))
def test_strongest_tree_spans_what_agrees(n, seed):
    rng = np.random.default_rng(seed)
    sigs, part = rng.integers(0, 2, (n, near_text.VALUES)).astype(np.uint8), rng.integers(0, n, n)
    least = near_text.VALUES // 2
    tree = near_text._strongest_tree(sigs, part, least)
    joined = [(i, j) for i in range(n) for j in range(i + 1, n) if part[i] == part[j]]
    edges = joined + [(i, j) for i in range(n) for j in range(i + 1, n) if (sigs[i] == sigs[j]).sum() >= least]
    assert all(part[a] != part[b] for a, b in tree) and roots(range(n), joined + [(min(p), max(p)) for p in tree]) == roots(range(n), edges)


def test_pair_recall_in_crowded_regions(spark):
    """Pairs at a similarity just above 0.85 whose regions also hold many texts that are near to neither, compared in small
    blocks: the recall that the number of trees promises."""
    rng, rows, pairs = random.Random(2), [], []
    for g in range(6):
        base = [f"b{g}_{i}" for i in range(200)]  # half of each text is a passage that 60 texts share
        for c in range(60):
            own = [f"o{g}_{c}_{i}" for i in range(200)]
            text, near = base + own, list(base + own)
            for at in rng.sample(range(0, 400, 4), 10):  # each change makes three new shingles: 368 / 428 = 0.86
                near[at] = f"x{g}_{c}_{at}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(near))]
    want, _ = brute_components(rows, 3, 85, 100)
    assert all(want[b] == a for a, b in pairs)
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(spark.createDataFrame(rows, DOCS), 3, (85, 100), region=16, block=16).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.99 * len(pairs) and all(got[i] == want[i] or got[i] == i for i in got)


def test_grouped_spans_batches():
    import pandas as pd

    frame = pd.DataFrame({"k": [1, 1, 2, 3, 3, 3, 4], "v": range(7)})
    batches = [frame.iloc[a:b] for a, b in ((0, 1), (1, 4), (4, 4), (4, 5), (5, 7))]
    assert [(g["k"].iat[0], g["v"].tolist()) for g in grouping.grouped(iter(batches), ["k"])] == [(1, [0, 1]), (2, [2]), (3, [3, 4, 5]), (4, [6])]


def test_slices():
    assert list(grouping.slices(["aa", None, "b" * 9, "c"], 4)) == [(0, 2), (2, 3), (3, 4)] and list(grouping.slices([], 4)) == []


# --- vectors -------------------------------------------------------------------------------------------------------
def clusters(rng, groups, size, dim=32, noise=0.02):
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        out += [c / np.linalg.norm(c) + noise * rng.standard_normal(dim) for _ in range(size)]
    return np.array(out, np.float32)


@pytest.mark.parametrize("tile", [1024, 7])
def test_near_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    x = np.vstack([clusters(rng, 12, 20), clusters(rng, 150, 1)])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, [float(v) for v in x[3]]), (1001, [float(v) for v in x[3]])]
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9, tile=tile).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = m @ m.T >= 0.9
    np.fill_diagonal(links, False)
    ids = [r[0] for r in rows]
    assert {i: got[i]["n_links"] for i in ids} == {i: int(n) for i, n in zip(ids, links.sum(axis=1), strict=True)}
    assert {i: got[i]["component_id"] for i in ids} == roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links), strict=True)])


def test_near_vectors_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (21, [0.0, 1.0, 0.0]), (22, [0.1, 1.0, 0.0]), (30, [1e-200, 1e-200]), (31, [1.0, 0.01]), (32, [-1e200, 1e200]), (33, [-2e200, 2e200]), (34, [5e-324, -0.4e-323]), (None, [1.0, 0.0]), (9, []), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, label long, n_links string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (31, 3, 1, False), (None, 0, None, False), (21, 1, 21, True), (22, 1, 21, False), (32, 1, 32, True), (33, 1, 32, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 30, 34)]
    assert got == sorted(want, key=repr)
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_cap_recall():
    rng = np.random.default_rng(4)
    z, words = near_vectors.cap_plan(50_000, 0.9)
    code = near_vectors.Filters(64, words, z)
    v = rng.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = rng.standard_normal((400, 64))
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    shared = [np.intersect1d(a, b).size > 0 for a, b in zip(code.decode(v), code.decode(0.9 * v + np.sqrt(0.19) * w), strict=True)]
    assert np.mean(shared) >= 0.97


# --- lines ---------------------------------------------------------------------------------------------------------
def brute_lines(rows, window=3):
    """doc_id to kept text, for distinct doc_ids."""
    spots = collections.defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            lines = t.split("\n")
            for p in range(max(1, len(lines) - window + 1)):
                w = tuple(lines[p : p + window])
                if any(x.strip() for x in w):
                    spots[w].append((i, p))
    gone = collections.defaultdict(set)
    for w, found in spots.items():
        first = min(found)
        for i, p in set(found) - {first}:
            start = max(p, first[1] + window) if i == first[0] and p < first[1] + window else p
            gone[i] |= set(range(start, p + len(w)))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14)))) for i in range(80)] + [(200, "a\na\na\na\na"), (201, "\n\n\n\n"), (202, ""), (203, None), (204, "x\n" * 5000), (205, "short text"), (206, "short text"), (207, "two\nlines"), (208, "two\nlines"), (209, "two\nlines\nand three"), (210, "short text\n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_lines(rows)


def test_long_text_with_many_removed_lines(spark):
    """200,000 lines all of which go: seconds, where a search of a list for each line would take hours."""
    import time

    text = "\n".join(f"line {i}" for i in range(200_000))
    began = time.time()
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\ntail")], DOCS)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"]) for r in got] == [(200_000, 0), (200_001, 200_000)] and got[1]["text"] == "tail" and time.time() - began < 60


def test_lines_cases(spark):
    df = spark.createDataFrame([(2, "p\nq\nr\ntail", "keep", 7), (1, "p\nq\nr", "k", None), (None, "p\nq\nr", None, 1), (1, "p\nq\nr", "k", None), (3, None, None, None)], "doc_id long, text string, gone string, n_lines int")
    got = sorted(((r["doc_id"], r["text"], r["gone"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    want = [(1, "p\nq\nr", "k", 3, 0), (1, "p\nq\nr", "k", 3, 0), (2, "tail", "keep", 4, 3), (3, None, None, 0, 0), (None, "p\nq\nr", None, 3, 0)]
    assert got == sorted(want, key=repr)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_lines_are_native(spark, data):
    plan = line_dedup.op10_line_windows(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_op10_equals_sql(spark, data):
    assert spark_rows(line_dedup.op10_line_windows(spark, data)) == sql_rows(data, line_dedup.OP10_SQL)


def test_op4_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want, sizes = brute_components(rows, 3, 85, 100)
    got = near_text.op4_lsh_forest(spark, data).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (sizes[i], want[i], want[i] == i) for i, _ in rows}


@pytest.mark.parametrize("planted", [False, True])
def test_op9_equals_brute_force(spark, data, tmp_path, planted):
    """The registered query on the table as it is, and with near copies put in: chains of them, pairs around 0.9 and exact copies."""
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    if planted:
        rng, first = np.random.default_rng(5), max(r[0] for r in rows) + 1
        for k in range(120):
            # of copies of copies every third is exact; the others' noise leaves cosines from 0.84 to 0.98
            base = np.array(rows[k % 40 if k < 40 else len(rows) - 40][1], np.float64)
            noise = rng.normal(size=base.size)
            noise *= (0 if k % 3 == 0 else 0.2 + 0.45 * rng.random()) * np.linalg.norm(base) / np.linalg.norm(noise)
            rows.append((first + k, [float(x) for x in (base + noise).astype(np.float32)]))
        data = str(tmp_path)
        spark.createDataFrame(rows, table.select("vec_id", "embedding").schema).write.parquet(f"{data}/embeddings.parquet")
    ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = m @ m.T >= 0.9
    np.fill_diagonal(links, False)
    assert not planted or links.sum() > 100
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links), strict=True)])
    got = near_vectors.op9_cap_filters(spark, data).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, links.sum(axis=1), strict=True)}


def test_filter_numbers_have_room():
    assert near_vectors.number_type(26_000) == "<i4" and near_vectors.number_type(27_000) == "<i8"
