"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.grouping import slices
from feedlake.llm.scratch import table

#: Words share this many rows of the vector table by hash, so it has a fixed size; dimensions; signs of an index vector.
ROWS, DIM, SIGNS = 8192, 32, 4
#: Words on either side that make a word's context, and the weight below which frequent words are damped.
REACH, DAMP = 2, 1e-3
#: Labelled rows that the network is fitted on at the most (chosen by a hash of doc_id); units of the first layer.
FIT_ROWS, HIDDEN = 20_000, 32
#: Groups in which the tasks' sums are added, step by step.
MERGED = (4096, 64)
#: Of the labelled rows that may be learnt from, those whose remainder this is calibrate the temperature.
CALIBRATE = 1
KEPT_WORDS = 500_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Word to its row of the table."""

    def __missing__(self, word: str) -> int:
        row = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % ROWS
        if len(word) <= 64 and len(self) < KEPT_WORDS:
            self[word] = row
        return row


def _words(texts, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word of all texts, number of words of each text); null and empty texts have none."""
    lists = [_TOKEN.findall(t) if t else () for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((buckets[w] for x in lists for w in x), np.int64, int(n.sum())), n


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero components of each row's random index vector."""
    rng = np.random.default_rng(3)
    return np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :SIGNS], rng.choice([-1.0, 1.0], (ROWS, SIGNS))


def _context_sums(words: np.ndarray, n: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """ROWS x (DIM + 1): sums of the neighbours' index vectors, and in the last column the number of occurrences."""
    out = np.zeros((ROWS, DIM + 1), np.float64)
    text = np.repeat(np.arange(len(n)), n)
    flat = np.zeros(ROWS * DIM)
    for off in range(1, REACH + 1):
        same = np.flatnonzero(text[off:] == text[:-off]) if len(words) > off else np.empty(0, int)
        a, b = words[same], words[same + off]
        for word, near in ((a, b), (b, a)):
            for j in range(SIGNS):
                flat += np.bincount(word * DIM + places[near, j], weights=signs[near, j], minlength=ROWS * DIM)
    out[:, :DIM] = flat.reshape(ROWS, DIM)
    out[:, DIM] = np.bincount(words, minlength=ROWS)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text", blocks: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(ROWS x DIM unit context vectors, weight of each row), counted over every document.

    A task sends its sums, in doubles, in blocks of a fixed size. They are added in three steps, by the task's number
    modulo 4096, then 64, then all, so that up to a million tasks no group holds more than some 250 blocks of 135 KB.
    What reaches the driver is one table of ROWS * (DIM + 1) numbers.
    """
    span = ROWS // blocks

    def each(batches):
        buckets, (places, signs) = Buckets(), index_vectors()
        total, seen = np.zeros((ROWS, DIM + 1)), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                words, n = _words(texts[a:b], buckets)
                total += _context_sums(words, n, places, signs)
            seen += len(batch)
        if seen:
            salt = TaskContext.get().partitionId() % MERGED[0]
            yield pd.DataFrame({"block": range(blocks), "salt": salt, "sums": [total[i * span : (i + 1) * span].tobytes() for i in range(blocks)]})

    def add(to: int):
        def of(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(span * (DIM + 1))
            for x in rows["sums"]:
                total += np.frombuffer(x)
            return pd.DataFrame({"block": rows["block"].iloc[:1], "salt": rows["salt"].iloc[:1] % to, "sums": [total.tobytes()]})

        return of

    kind = "block int, salt int, sums binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(each, kind)
    for to in (*MERGED[1:], 1):
        parts = parts.groupBy("block", "salt").applyInPandas(add(to), kind)
    table_ = np.zeros((ROWS, DIM + 1))
    for r in parts.groupBy("block", "salt").applyInPandas(add(1), kind).collect():
        table_[r["block"] * span : (r["block"] + 1) * span] = np.frombuffer(r["sums"]).reshape(span, DIM + 1)
    vectors, count = table_[:, :DIM].copy(), table_[:, DIM]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors, DAMP / (DAMP + count / max(count.sum(), 1.0))


def pooled(texts, buckets: Buckets, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per text: the weighted mean of its words' context vectors beside the plain mean of their index vectors."""
    texts = list(texts)
    parts = [_pooled(texts[a:b], buckets, vectors, weight) for a, b in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM))


def _pooled(texts: list, buckets: Buckets, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    words, n = _words(texts, buckets)
    text = np.repeat(np.arange(len(n)), n)
    cell = np.bincount(text * 1, minlength=len(n))
    places, signs = index_vectors()
    out = np.zeros((len(n), 2 * DIM))
    w = weight[words]
    total = np.maximum(np.bincount(text, weights=w, minlength=len(n)), 1e-12)[:, None]
    for d in range(DIM):
        out[:, d] = np.bincount(text, weights=w * vectors[words, d], minlength=len(n))
    out[:, :DIM] /= total
    for j in range(SIGNS):
        flat = np.bincount(text * DIM + places[words, j], weights=signs[words, j], minlength=len(n) * DIM)
        out[:, DIM:] += flat.reshape(len(n), DIM)
    out[:, DIM:] /= np.maximum(cell, 1)[:, None]
    return out


def fit_network(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, seed: int = 5) -> dict:
    """A tanh layer and a logistic one by Adam on standardised inputs, then the temperature that gives the calibration
    rows the least log-loss. With labels of one kind, or none, the score is their (smoothed) share."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
    rng = np.random.default_rng(seed)
    p = {"w1": rng.standard_normal((2 * DIM, HIDDEN)) / np.sqrt(2 * DIM), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1)}
    base = {"mean": mean, "scale": scale, "t": 1.0}
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return base | p | {"b2": np.array([np.log(share / (1 - share))])}
    z, fit = (x - mean) / scale, np.flatnonzero(~calibrate)
    if len(np.unique(y[fit])) < 2:
        fit = np.arange(len(y))
    m, v, step = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(err, p["w2"]) * (1 - h * h)
            grad = {"w1": z[rows].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + 1e-4 * p["w2"], "b2": np.array([err.sum()])}
            step += 1
            rate = 5e-3 * (1 - epoch / epochs)
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(calibrate) if calibrate.any() else fit
    logit = np.tanh(z[held] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    ts = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t) for t in ts]
    return base | p | {"t": float(ts[int(np.argmin(loss))])}


def apply_network(net: dict, x: np.ndarray) -> np.ndarray:
    h = np.tanh((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"])
    return 1 / (1 + np.exp(-np.clip((h @ net["w2"] + net["b2"]) / net["t"], -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with held_out, score and predicted (which replace columns of these names).

    Method: every word has a sparse random index vector; its context vector is the sum of its neighbours' index
    vectors over all documents. A document's features are the damped mean of its words' context vectors and the mean of
    their index vectors; a two-layer network on them, temperature-calibrated, gives the score. Only the text is an
    input. Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, on a sample of fit_rows of
    them (by a hash of doc_id); the counts are over all documents, and every document is scored.

    held_out: whether that remainder is 0 (null doc_id: null counts as held out). Null and empty texts have zero
    features and get the score that the network gives these. Labels that are null or have a null doc_id are left out;
    several labels of one document count as their mean, rounded; of several texts of one doc_id one is learnt from. Other columns pass through. An empty table of
    documents gives an empty table; without labels the score is 0.5.
    """
    spark = docs.sparkSession
    vectors, weight = word_vectors(docs, text_col)
    shared = spark.sparkContext.broadcast((vectors, weight))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null").where(rest != 0)
    sample = known.groupBy("doc_id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # one text a doc_id, before anything is collected
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        buckets = Buckets()
        for batch in batches:
            x = pooled(batch["text"], buckets, *shared.value).astype(np.float32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [r.tobytes() for r in x]})

    got = texts.mapInPandas(features, "doc_id long, y double, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, 2 * DIM).astype(np.float64)
    calibrate = np.array([zlib.crc32(str(i).encode()) % 5 == CALIBRATE for i in got["doc_id"]], bool)
    net = fit_network(x, got["y"].to_numpy(np.float64), calibrate)

    def score(batches):
        buckets = Buckets()
        for batch in batches:  # Arrow batches: the other columns pass as they are
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            out = apply_network(net, pooled(texts, buckets, *shared.value)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    kept = docs.select(*names)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    scored = kept.mapInArrow(score, f"{kind}, score double")
    own = F.crc32(F.col(id_col).cast("long").cast("string")) % 5
    return scored.select(*[F.col(f"`{c}`") for c in names], F.coalesce(own == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op8_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
