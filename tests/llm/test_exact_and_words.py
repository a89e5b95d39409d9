import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from feedlake.llm import exact_text, resampling, spelling

DOCS = "doc_id long, text string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11 ----------------------------------------------------------------------------------------------------------
def test_op11_equals_its_sql(spark, data):
    assert spark_rows(exact_text.op11_chunk_recipes(spark, data)) == sql_rows(data, exact_text.OP11_SQL)


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_op11_hashes_that_collide_are_told_apart(spark, data, bits):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert spark_rows(exact_text.exact_duplicates(docs, bits=bits, sentences=4)) == sql_rows(data, exact_text.OP11_SQL)


def test_op11_odd_rows(spark):
    long_ = "Äb. " * 50_000
    rows = [(1, None), (2, ""), (None, "a. b"), (3, "A. B"), (4, "é"), (5, "É"), (6, long_), (7, long_.replace("b", "B")), (8, long_ + "x"), (9, "q"), (9, "q"), (None, "z"), (None, "Z"), (10, "\n\n"), (11, "\n"), (12, "a.\x1eb"), (13, "a.b"), (14, "a.\x1e\x1eb")]
    extra = spark.createDataFrame(rows, DOCS).withColumns({"keep_id": F.lit(1), "row": F.lit(2), "hash": F.lit("x"), "n": F.lit(0)})
    for sentences in (1, 16):
        check_odd_rows(rows, exact_text.exact_duplicates(extra, sentences=sentences).collect())
    assert exact_text.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def check_odd_rows(rows, found):
    got = collections.defaultdict(list)
    for r in found:
        got[r["text_sha256"]].append(r)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256((t or "").translate(AZ).encode()).hexdigest()].append(i)
    assert {k: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in v) for k, v in got.items()} == {k: sorted((i is None, i or 0) for i in v) for k, v in want.items()}
    for k, group in got.items():
        most = max((i for i in want[k] if i is not None), default=None)
        assert {r["keep_id"] for r in group} == {most} and {r["group_size"] for r in group} == {len(group)}
        assert [r["doc_id"] for r in group if r["kept"]] == [most]


def test_op11_chunks_are_cut_by_content(spark):
    rng = random.Random(1)
    text = "".join(f"sentence {rng.randrange(10**9)}. " for _ in range(2000))
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(exact_text.chunks(F.col("t"))).first()[0]
    one, two = cut(text), cut("One more. " + text[:30_000] + "another, " + text[30_000:])
    assert "".join(one) == text and 50 < len(one) < 300
    assert len(set(one) - set(two)) <= 4


def test_op11_runs_no_python(spark, data):
    plan = exact_text.op11_chunk_recipes(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op11_drop(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], DOCS)
    assert sorted(map(tuple, exact_text.drop_exact_duplicates(docs).collect())) == [(2, "a"), (3, "b")]


# --- op12 ----------------------------------------------------------------------------------------------------------
def plain_counts(rows, least_length, least_count, spoilt):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(AZ)
            if spoilt and (h := zlib.crc32(f"{'' if i is None else i}:{w}".encode())) % spoilt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least_length
    return {w: k for w, k in n.items() if k >= least_count and k}


def plain_variants(n, ratio=2):
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = collections.defaultdict(list)
    for k, words in by_length.items():
        for i, a in enumerate(words):
            for b in words[i + 1 :] + by_length.get(k + 1, []):
                if near(a, b):
                    found[a].append(b)
                    found[b].append(a)
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= ratio * n[w]:
            form[w] = best
    if not ratio:  # forms may go round: the best near word alone
        return form
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_op12_equals_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want, got = plain_variants(plain_counts(docs, 5, 3, 97)), rows_of(spelling.op12_deletion_keys(spark, data))
    assert [pair for pair in zip(got, want) if pair[0] != pair[1]][:5] == [] and len(got) == len(want) and any(f for _, f, *_ in want)


def test_op12_chains_and_doubled_letters(spark):
    n = {"hello": 1, "helo": 40, "hallo": 5, "heloo": 2, "helllo": 9, "xelo": 100, "aaaa": 3, "aaa": 3, "aaaaa": 6, "é": 7, "e": 1}
    for k in range(12):  # a chain of forms, each twice as frequent
        n["chain" + "b" * k + "c" * (11 - k)] = 2**k
    texts = [(1, " ".join(w for w, k in n.items() for _ in range(k))), (None, None), (2, "")]
    docs = spark.createDataFrame(texts, DOCS).withColumn("word", F.lit("clash"))
    got = rows_of(spelling.spelling_variants(docs, least_length=1, least_count=1))
    assert got == plain_variants(n)
    assert {r[0]: r[2] for r in got}["chain" + "c" * 11] == "chain" + "b" * 11


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abé", min_size=1, max_size=5), st.integers(1, 9), min_size=1, max_size=40))
def test_near_words_equal_brute_force(n):
    import numpy as np
    import pandas as pd

    words = list(n)
    for collide in (False, True):
        keys, at, which = spelling.deletion_keys(words)
        rows = pd.DataFrame({"key": keys // 2**62 if collide else keys, "at": at, "word": np.array(words, object)[which], "n": np.array([n[w] for w in words])[which]})
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        got = {r.word: (r.n_near, r.near, r.near_n) for r in spelling.near_words(rows).itertuples()}
        want = {w: k for w, _, _, _, k, _ in plain_variants(n) if k}
        assert {w: v[0] for w, v in got.items()} == want
        best = plain_variants(n, ratio=0)
        assert all(v[1] == best[w] and v[2] == n[v[1]] for w, v in got.items())


def test_op12_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words"), (1, None)], DOCS)).count() == 0


# --- op13 ----------------------------------------------------------------------------------------------------------
def plain_resample(rows, target, longest=1, least=20):
    def features(t):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(AZ))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can_be = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(can_be[: 10 * len(can_be) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_op13_equals_brute_force(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert drawn_of(resampling.op13_importance_resampling(spark, data)) == plain_resample(docs, target)


@pytest.mark.parametrize("chars", [1, 300, 10**6])
def test_op13_odd_rows_and_longer_runs(spark, chars):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "Of", "été", "x1", "Ÿ", "naïve", "日本", "end"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(80)] + [(None, None), (None, " ".join(["the"] * 30)), (5, ""), (6, " ".join(["the"] * 30)), (6, " ".join(["the"] * 30)), (2**60, "the " * 50_000), (7, "?!")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"block": F.lit("x"), "score": F.lit(1), "rank": F.lit(1), "features": F.lit(0)})
    target = ["the end of été", None, "", "The 日本 x1"]
    got = drawn_of(resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), ngrams=(1, 2), chars=chars))
    assert got == plain_resample(rows, target, 2)


def test_op13_moves_buckets_and_not_texts(spark, monkeypatch):
    """A task holds one slice of texts and a number a bucket: no intermediate table has a row that grows with the texts, and none
    but the scores has more rows than there are buckets for each task."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(25)]).alias("text")).repartition(2)
    widest, kept = {}, resampling.stash

    def watched(df, label, *how):
        out = kept(df, label, *how)
        sizes = out.select(F.octet_length(F.to_json(F.struct(*out.columns))).alias("n")).agg(F.count("*"), F.max("n")).first()
        widest[label] = tuple(max(x) for x in zip(sizes, widest.get(label, (0, 0)), strict=True))
        return out

    monkeypatch.setattr(resampling, "stash", watched)
    got = drawn_of(resampling.resample(docs, docs.limit(3), buckets=100))
    assert len(got) == 6000 and sum(r[1] for r in got) == 150_000
    assert all(longest < 200 for _, longest in widest.values()) and all(n <= 200 for label, (n, _) in widest.items() if label != "scored")


def test_op13_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).count() == 0
    got = drawn_of(resampling.resample(spark.createDataFrame([(1, "a b " * 20)], DOCS), none))
    assert got == plain_resample([(1, "a b " * 20)], [])
