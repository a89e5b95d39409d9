import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import queries
from feedlake.llm.scratch import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """Every stage's input and output on the small tables."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, data), name)
        out[name] = (before, docs)
    return out


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][1].columns == COLUMNS


def test_clean_documents_stay(spark, data, stages):
    before, after = stages["quality"]
    good = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").join(before, "doc_id", "left_semi").select("doc_id")
    assert good.join(after, "doc_id", "left_semi").count() >= 0.98 * good.count()


def test_no_window_of_lines_repeats(stages):
    _, after = stages["lines"]
    docs = after.select("doc_id", F.split("text", "\n").alias("l"))
    spots = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.array_join(F.slice("l", i, F.lit(3)), "\n"))
    windows = docs.where("size(l) >= 3").select("doc_id", F.explode(spots).alias("w")).where(F.col("w").rlike(r"\S"))
    before = stages["lines"][0].count()
    assert after.count() <= before and windows.groupBy("w").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").count() == 0


def test_one_of_each_group(stages):
    from feedlake.llm.near_text import near_duplicates

    before, after = stages["near"]
    groups = near_duplicates(before, 5, (80, 100))
    assert after.count() == groups.select("component_id").distinct().count()


def test_mix_takes_sources_near_their_targets(stages):
    from feedlake.llm.mixing import n_words, targets

    before, after = stages["mix"]
    words = lambda df: df.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    target = {r["source"]: r["target"] for r in targets(words(before)).collect()}
    taken = {r["source"]: r["source_size"] for r in words(after).collect()}
    most = before.select(F.max(n_words(F.col("text")))).first()[0]
    assert all(abs(taken.get(s, 0) - t) <= most for s, t in target.items())


def test_packing_holds_every_word(stages):
    from feedlake.llm.mixing import n_words

    before, after = stages["pack"]
    assert after.agg(F.sum("n_tokens")).first()[0] == before.select(F.sum(n_words(F.col("text")))).first()[0]


def test_sequences_follow_the_training_order(stages):
    """Of two documents that are packed far apart the one earlier in the files of mix has the smaller place, and a document's
    two takings have two places."""
    before, after = stages["pack"]
    name = F.col("_metadata.file_name")
    order = [r["doc_id"] for r in before.select("doc_id", name.alias("n"), F.col("_metadata.row_index").alias("i")).orderBy(F.length("n"), "n", "i").collect()]
    got = after.where("piece = 0").orderBy("place").collect()
    assert [r["doc_id"] for r in got] == order and len({r["place"] for r in got}) == len(got)
    first = after.where("bin_id is not null").groupBy("bin_id").agg(F.min("place").alias("p")).orderBy("bin_id").collect()
    assert [r["p"] for r in first] == sorted(r["p"] for r in first)


def test_schedules_move_documents(spark, data, stages):
    """Sources that fade in lie later in the training than sources that fade out."""
    before, _ = stages["mix"]
    from feedlake.llm.mixing import curriculum, training_order

    rows = training_order(curriculum(before, cut=False)).groupBy("source").agg(F.avg("__position").alias("p")).orderBy("source").collect()
    steady, late, early = (sum(r["p"] for r in rows[k::3]) / len(rows[k::3]) for k in range(3))  # of few documents each
    assert early < steady < late and late - early > 0.05


def test_empty_and_odd_documents(spark, data):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", None, 0, 1), (2, None, None, "s", None, 1), (3, "a b c", "en", "s", 5, 1), (3, "a b c", "en", "s", 5, 1), (4, "d e f g h", "en", "s", 9, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    keep_all = ("quality", lambda spark, docs, sf_dir: docs.select(*COLUMNS))  # what a classifier thinks of these texts is not the point
    for docs, want in ((odd, [3, 3, 4]), (odd.where("false"), [])):
        for name, stage in [keep_all, *corpus_pipeline.STAGES[1:]]:
            docs = stash(stage(spark, docs, data), name)
        got = docs.groupBy("doc_id", "place").count().collect()
        assert len(got) == docs.count() and {r["doc_id"] for r in got} <= set(want) and (not want or {r["doc_id"] for r in got} == set(want))
        assert docs.where("bin_id is null").count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, odd, data).columns == COLUMNS and corpus_pipeline.STAGES[0][1](spark, odd.where("false"), data).count() == 0


def test_rows_without_an_id_stay(spark, data):
    rows = [(None, "a text of its own", "en", "s", 17), (1, "quite another text here", "en", "s", 23), (None, "and a third one", "en", "s", 15), (2, "quite another text here", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stash(stage(spark, docs, data), name)
    assert sorted(r["text"] for r in docs.collect()) == sorted(t for i, t, *_ in rows if i != 2)


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mix", "pack"]
