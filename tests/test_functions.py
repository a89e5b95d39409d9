import json

import pytest
from pyspark.sql import functions as F

from feedlake.functions import json_walk, text, values
from feedlake.functions.urls import absolute_url, normalized_url, url_hash


@pytest.mark.parametrize(("url", "out"), [
    ("https://Example.com/path?utm_source=newsletter&id=42&gclid=abc", "https://example.com/path?id=42"),
    ("https://Example.com/path/to/article/", "https://example.com/path/to/article"),
    ("not a url/?utm_source=x&keep=yes/", "not a url?keep=yes%2F"),
    ("https://example.com:443/?b=2&a=1#top", "https://example.com/?a=1&b=2"),
    ("", ""), (None, None),
])
def test_normalized_url(url, out):
    assert normalized_url(url) == out


def test_equal_urls_have_equal_hashes(spark):
    df = spark.createDataFrame([("https://Example.com/a/?utm_medium=x",), ("https://example.com/a",)], "u string")
    assert df.select(url_hash(F.col("u"))).distinct().count() == 1


def test_absolute_url():
    assert absolute_url("https://a.b/c/", "d?e=1") == "https://a.b/c/d?e=1"
    assert absolute_url("https://a.b/", None) == ""


def test_identifiers_walk():
    assert sorted(json_walk.identifiers_of({"DOI": "https://doi.org/10.1000/ABC.123", "nested": {"external_id": " Record-42 "}})) == ["doi:10.1000/abc.123", "externalId:record-42"]
    deep = {"a": {"b": {"c": {"d": {"doi": "10.1/x"}}}}}
    assert json_walk.identifiers_of(deep) == set()
    assert json_walk.identifiers_of([{"doi": [1, "10.1/Y"]}]) == {"doi:1", "doi:10.1/y"}


def test_researchers_walk():
    assert json_walk.researchers_of({"creators": [{"name": "Dr. Ada Lovelace"}, {"full_name": "Grace Hopper"}]}) == ["Dr. Ada Lovelace", "Grace Hopper"]
    assert json_walk.researchers_of("Bare Name") == ["Bare Name"]


def test_strings_walk_passes_over_lists():
    assert json_walk.strings_of({"a": " x  y ", "b": ["no"], "c": {"d": {"e": {"f": "deep"}}}}) == ["x y"]


@pytest.mark.parametrize(("score", "band"), [(24, "IGNORE"), (25, "LOW"), (49, "LOW"), (50, "MEDIUM"), (74, "MEDIUM"), (75, "HIGH"), (-20, "IGNORE"), (120, "HIGH")])
def test_bands(spark, score, band):
    assert spark.range(1).select(values.band(F.lit(float(score)))).first()[0] == band


def test_text_columns(spark):
    staged = spark.createDataFrame([("  Side Scan — SONAR/3-D (ﬁne) ", "A Title: of, THINGS!")], "a string, b string").withColumn("key", text.normalize_key(F.col("a")))
    row = staged.select("key", text.normalize_title(F.col("b")).alias("title"), text.phrases_found(F.col("key"), ["sonar", "scan", "can"]).alias("hits"), text.title_tokens(F.col("b")).alias("tokens")).first()
    assert row["key"] == "side scan sonar/3-d fine"
    assert row["title"] == "a title of things"
    assert row["hits"] == ["scan", "sonar"]
    assert row["tokens"] == ["title", "of", "things"]


def test_arrays(spark):
    df = spark.createDataFrame([(["b", "A ", " a", "", "Zed", "NeRF", "AUV"],)], "x array<string>")
    row = df.select(text.merge_names(F.col("x")).alias("names"), text.merge_arrays(F.col("x")).alias("kept"), text.unique_sorted(F.col("x")).alias("sorted")).first()
    assert row["names"] == ["A", "AUV", "b", "NeRF", "Zed"]
    assert row["kept"] == ["b", "A", "Zed", "NeRF", "AUV"]
    assert row["sorted"] == ["A", "AUV", "NeRF", "Zed", "b"]


def test_secrets_are_redacted(spark):
    row = spark.range(1).select(text.sanitize_value(F.lit("<b>x</b> token=abc https://a.b/c y")).alias("a"), text.error_message(F.lit("Bearer abc https://u:p@h/ ?token=1")).alias("b"), text.mask_dsn(F.lit("postgres://user:pw@host/db")).alias("c"), text.sanitize_value(F.lit('{"a":1}')).alias("d")).first()
    assert row["a"] == "x token [redacted] y" and "abc" not in row["b"] and "u:p" not in row["b"] and row["c"] == "postgres://user:****@host/db" and row["d"] == "" and row["b"] == "Bearer [redacted] https://[redacted]@h/ ?token=[redacted]"
    told = ["password: 'a b' x", "client_secret=q&z=1", "API-KEY : k1, next", "token\u00a0=\u00a0v", "a \x07 bell", "  ", "ﬁx"]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(told)), "i int, s string").select("i", text.error_message(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == ["password=[redacted] x", "client_secret=[redacted]&z=1", "API-KEY=[redacted], next", "token=[redacted]", "a bell", "Embedding request failed.", "fix"]
    codes = spark.createDataFrame([("Provider BAD/Response",), (" ",), (None,), ("Ｔimeout",)], "s string").select(text.error_code(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["provider_bad_response", "unknown_error", "unknown_error", "timeout"]


def test_names_are_composed(spark):
    row = spark.createDataFrame([(["ﬁx", "fix", "Ａ"], ["ﬀ", "ff"])], "a array<string>, b array<string>").select(text.unique_normalized(F.col("a")).alias("a"), text.unique_sorted(F.col("b")).alias("b"), text.merge_names(F.col("a"), F.col("b")).alias("c")).first()
    assert row["a"] == ["A", "fix"] and row["b"] == ["ff"] and row["c"] == ["A", "ff", "fix"]


def test_phrases_equal_patterns(spark):
    """One pattern for all phrases beside a test of each."""
    from feedlake.functions import vocabulary as V

    phrases = [*V.NOVELTY_LANGUAGE, *V.BUILDABLE_CONTEXTS, *V.REPOSITORY_LANGUAGE, *(p for names in V.DOMAIN_ALIASES.values() for p in names)]
    texts = [" ".join(phrases), "newly discovered newly mapped", "open-source github.com re-new new/x", "underwater cultural heritage visualization", "anew newt xr2 3d models", "", "new"] + [f"a {p}s {p} {p}" for p in phrases[:20]]
    keys = sorted(set(map(text.key_of, phrases)))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.phrase_keys(F.col("t"), phrases).alias("got"), F.array_compact(F.array(*[F.when(text.has_phrase(F.col("t"), k), k) for k in keys])).alias("want"))
    assert all(sorted(r["got"]) == r["want"] for r in df.collect())


def test_cosine_of_nothing(spark):
    row = spark.range(1).select(values.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("z"), values.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("o")).first()
    assert row["z"] is None and row["o"] == 1.0


def test_number_fields_are_typed(spark):
    df = spark.createDataFrame([(json.dumps({"stars": "5", "n": 7, "neg": -1}),), (None,), ("no json",)], "raw string")
    assert [tuple(r) for r in df.select(json_walk.number_field(F.col("raw"), ["stars", "n"]), json_walk.number_field(F.col("raw"), ["neg"])).collect()] == [(7.0, None), (None, None), (None, None)]


def test_identifiers_without_python(spark):
    import json

    docs = [{"DOI": "https://doi.org/10.1000/ABC.123", "nested": {"external_id": " Record-42 "}}, [{"doi": [1, "10.1/Y", True, None, {"doi": "in"}]}], {"a": {"b": {"c": {"doi": "deep"}}}}, {"a": {"b": {"c": {"d": {"doi": "too deep"}}}}}, {"doi": 10.5, "isbn": 5.0, "x": [[{"doi": "x"}]]},
            {"doi": " DOI: 10.1 / 2 "}, {"Doi": "http://dx.doi.org/10.5/a\u00a0b"}, {"doi": ""}, "doi", 7, None, {"doi": {"doi": "nested"}}, {"doi": False}]
    rows = [json.dumps(d) for d in docs] + [None, "", "{", "nul"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", json_walk.identifiers(F.col("t")).alias("x"))
    got = {r["i"]: r["x"] for r in df.collect()}
    assert got == {i: sorted(json_walk.identifiers_of(json_walk._load(t))) for i, t in enumerate(rows)}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
