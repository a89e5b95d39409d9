"""Full-text search over an inverted index: posting lists in blocks with their best scores, for many searches at once.

The index has a row for each stem and block of documents: the documents that hold the stem with its places, and the most
occurrences that one of them has. Kept as a table bucketed by both, a search touches the lists of its own stems in those
blocks alone that can reach its first results, and no text at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from feedlake.functions.text import SLICE_CHARS, slices  # noqa: F401
from feedlake.operators.kept import kept
from feedlake.operators.search import ALL_SQUARES, LAST_PLACE, MOST_PLACES, WORD_WEIGHT, Stems, parse_query, squares, words_of

#: Documents of a block, about; what stands for "every document" among the stems.
BLOCK_DOCS, EVERY = 1024, ""
#: Characters of a block's texts, about; stems asked for up to which they are sent to the index's lists.
BLOCK_CHARS, FEW_STEMS = 4_000_000, 10_000
PARSED = ArrayType(ArrayType(StructType([StructField("negated", BooleanType()), StructField("stems", ArrayType(StringType()))])))


def build_index(rows: DataFrame, text: Column, id_col: str = "id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(stem, block, most, docs) from rows with a distinct, non-null id: docs is an array of (id, places), places from 1 on in
    order; most the largest number of places among them. Each text is stemmed once; a block holds about block_docs
    documents, by a hash of the id, or fewer where they are long (about BLOCK_CHARS of texts), so no list grows with the corpus. The
    stem '' lists every document, without places. Texts are brought to their blocks, and a block's lists are made in one place.
    """
    slim = rows.select(F.col(id_col).alias("id"), text.alias("text"))
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    count = max(1, -(-size["n"] // block_docs), -(-size["chars"] // BLOCK_CHARS))
    slim = slim.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    kind, stems = slim.schema["id"].dataType.simpleString(), Stems()  # kept from block to block

    def lists(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids = table["id"].combine_chunks()
        codes, sizes, known = [], [], {"": 0}
        for doc in table["text"]:
            of = [known.setdefault(s, len(known)) for s in map(stems.__getitem__, words_of(doc.as_py()))]
            codes.append(np.array(of, np.int32))
            sizes.append(len(of))
        code = np.concatenate(codes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(1, len(code) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(code, kind="stable")  # documents and places stay in order
        order = order[np.searchsorted(code[order], 1):]  # stop words are in no list
        code, doc, place = code[order], doc[order], place[order]
        starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))  # of each stem and document
        many = np.diff(starts, append=len(code))
        firsts = np.flatnonzero(np.diff(code[starts], prepend=-1) != 0)  # of each stem
        most = np.maximum.reduceat(many, firsts) if len(firsts) else many
        places = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        every = len(sizes)
        docs = pa.StructArray.from_arrays([pa.concat_arrays([ids, ids.take(pa.array(doc[starts]))]), pa.concat_arrays([places(np.zeros(every + 1), []), places(np.append(starts, len(code)), place)])], names=["id", "places"])
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], firsts + every, [every + len(starts)]]), pa.int32()), docs)
        return pa.table({"stem": pa.array(known, pa.string()), "block": pa.array([table["block"][0].as_py()] * len(known), pa.int32()), "most": pa.array(np.append(0, most), pa.int32()), "docs": held})

    return slim.groupBy("block").applyInArrow(lists, f"stem string, block int, most int, docs array<struct<id:{kind},places:array<int>>>")


def save_index(index: DataFrame, name: str, buckets: int) -> DataFrame:
    """The index as a table bucketed and sorted by stem and block: joins with it move none of its lists."""
    index.write.mode("overwrite").bucketBy(buckets, "stem", "block").sortBy("stem", "block").saveAsTable(name)
    return index.sparkSession.table(name)


@F.pandas_udf(PARSED)
def _parsed(queries: pd.Series) -> pd.Series:
    return queries.map(lambda q: [[{"negated": neg, "stems": stems} for neg, stems in alt] for alt in parse_query(q or "")])


def _real(stems: Column) -> Column:
    return F.filter(stems, lambda s: s != "")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, alternatives, every, together, sole) of (query_id, query): all stems in order; whether the rank is that of
    nearness; the stems each of which is an alternative alone. Blank queries fall out."""
    rows = queries.select("query_id", _parsed("query").alias("alternatives")).where(F.size("alternatives") > 0)
    alts = F.col("alternatives")
    every = F.array_sort(F.array_distinct(_real(F.flatten(F.flatten(F.transform(alts, lambda a: F.transform(a, lambda p: p["stems"])))))))
    rows = rows.withColumn("every", every)
    one = F.get(F.get(alts, F.lit(0)), F.lit(0))
    several = (F.size(F.get(alts, F.lit(0))) > 1) | (~one["negated"] & (F.size(_real(one["stems"])) > 1))
    sole = F.transform(F.filter(alts, lambda a: (F.size(a) == 1) & ~F.get(a, F.lit(0))["negated"] & (F.size(F.get(a, F.lit(0))["stems"]) == 1)), lambda a: F.get(F.get(a, F.lit(0))["stems"], F.lit(0)))
    return rows.withColumn("together", (F.size(alts) == 1) & several & (F.size("every") > 1)).withColumn("sole", sole)


def _worth(n: Column) -> Column:
    """What n occurrences count."""
    return F.element_at(F.array(*[F.lit(x) for x in squares()]), F.least(n, F.lit(MOST_PLACES)) + 1)


def _places(held: Column, s: Column) -> Column:
    return F.coalesce(F.try_element_at(held, s), F.array().cast("array<int>"))


def _holds(held: Column, stems: Column) -> Column:
    """Whether a document with these places has the word, or the words at their distances (stop words are gaps)."""
    begin = _places(held, F.get(stems, F.lit(0)))
    rest = lambda at: F.forall(F.transform(stems, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: (x["s"] == "") | F.array_contains(_places(held, x["s"]), at + x["k"]))
    return F.when(F.size(stems) == 1, F.size(begin) > 0).otherwise(F.exists(begin, rest))


def _matches(held: Column, alternatives: Column) -> Column:
    return F.exists(alternatives, lambda a: F.forall(a, lambda p: _holds(held, p["stems"]) != p["negated"]))


def _rank(held: Column, every: Column, together: Column) -> Column:
    """As search.text_search ranks, from the places alone."""
    alone = F.aggregate(every, F.lit(0.0), lambda total, s: total + _worth(F.size(_places(held, s)))) * (F.lit(WORD_WEIGHT / ALL_SQUARES) / F.size(every))
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))
    first = lambda i: F.transform(F.slice(_places(held, F.get(every, i)), 1, MOST_PLACES), lambda x: F.least(x, F.lit(LAST_PLACE)))

    def apart(left: Column, one: Column, two: Column) -> Column:
        pairs = lambda a, left: F.aggregate(two, left, lambda rest, b: rest * (1.0 - WORD_WEIGHT * F.sqrt(near(F.abs(a - b).cast("double")))))
        return F.aggregate(one, left, lambda left, a: pairs(a, left))

    others = lambda left, i: F.aggregate(F.sequence(F.lit(0), i - 1), left, lambda acc, k: apart(acc, first(i), first(k)))
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(every) - 1, F.lit(1))), F.lit(1.0), others)
    held_stems = F.size(F.filter(every, lambda s: F.size(_places(held, s)) > 0))
    return F.when(~together, alone).otherwise(F.when(held_stems > 1, 1.0 - product).otherwise(1e-20))


def sent(terms: DataFrame) -> DataFrame:
    """terms, broadcast where they are few: the index then stays where it is."""
    return F.broadcast(terms) if terms.limit(FEW_STEMS + 1).count() <= FEW_STEMS else terms


def blocks_to_read(index: DataFrame, parsed: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, block, stems): the blocks that may hold one of a query's first `limit` results, with its stems there.

    A block without a stem that every alternative needs is out. Of ranks that add up, a block's best is at most the sum of its
    stems' best, and where a stem alone is enough it is at least that one's: blocks whose most lies under the limit-th of these
    least values, one document each, can be left unread.
    """
    needs_all = F.exists("alternatives", lambda a: F.forall(a, lambda p: p["negated"]))
    asked = F.concat("every", F.when(needs_all, F.array(F.lit(EVERY))).otherwise(F.array().cast("array<string>")))
    terms = sent(parsed.select("query_id", F.explode(asked).alias("stem")))
    here = index.select("stem", "block", "most").join(terms, "stem").groupBy("query_id", "block").agg(F.collect_list(F.struct("stem", "most")).alias("x"))
    both = here.join(parsed, "query_id").withColumn("stems", F.col("x.stem"))
    can_match = F.exists("alternatives", lambda a: F.forall(a, lambda p: p["negated"] | F.forall(_real(p["stems"]), lambda s: F.array_contains("stems", s))))
    scale = F.lit(WORD_WEIGHT / ALL_SQUARES) / F.size("every")
    top = F.when(F.col("together"), 1.0).otherwise(F.aggregate("x", F.lit(0.0), lambda total, e: total + _worth(e["most"])) * scale)
    sure = F.when(F.col("together"), 0.0).otherwise(F.coalesce(F.array_max(F.transform(F.filter("x", lambda e: F.array_contains("sole", e["stem"])), lambda e: _worth(e["most"]))), F.lit(0.0)) * scale)
    rated = both.where(can_match).select("query_id", "block", "stems", F.round(top + 1e-9, 9).alias("top"), F.round(sure, 9).alias("sure"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sure")))
    bar = rated.select("query_id", "sure").withColumn("r", place).where(F.col("r") <= limit).groupBy("query_id").agg(F.max(F.when(F.col("r") == limit, F.col("sure"))).alias("bar"))
    return rated.join(bar, "query_id").where(F.col("bar").isNull() | (F.col("top") >= F.col("bar"))).select("query_id", "block", "stems")


def search_index(index: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, id, score, rank): of each of the (query_id, query) rows the first `limit` documents, highest score first, then by
    id, as search.text_search finds and ranks them over the texts. Blank queries and those of stop words have no rows.

    Queries are words (all of them), "phrases", OR and -negations, as many at once as there are. Lists of a stem and block are
    joined by their keys; what meets is a row for each query and document that holds one of its stems in a block worth reading.
    """
    parsed = kept(parse_queries(queries))
    chosen = blocks_to_read(index, parsed, limit).select("query_id", "block", F.explode("stems").alias("stem"))
    stems = parsed.select(F.explode("every").alias("stem")).unionAll(parsed.limit(1).select(F.lit(EVERY))).distinct()
    lists = index.select("stem", "block", "docs").join(sent(stems), "stem", "left_semi").join(chosen, ["stem", "block"])
    docs = lists.select("query_id", "stem", F.explode("docs").alias("d")).select("query_id", "stem", "d.id", "d.places")
    held = docs.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "places"))).alias("held"))
    found = held.join(parsed, "query_id").where(_matches(F.col("held"), F.col("alternatives")))
    scored = found.select("query_id", "id", _rank(F.col("held"), F.col("every"), F.col("together")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit)
