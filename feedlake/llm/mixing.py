"""Mixing sources to target weights over the course of training (a curriculum)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.scratch import stash, table

#: A word, as everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
#: op5: weights of the sources in order, the share of all words to take, and the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), (3, 2), 2
#: A schedule: (progress, weight) points of a line from 0 to 1; a source's share of each moment of the training.
FLAT = ((0.0, 1.0), (1.0, 1.0))
#: Sources take these schedules in turn: steady, fading in, fading out. Each has the integral 1.
SCHEDULES = (FLAT, ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, ord, target) from (source, source_size): sources in code point order, null last, take
    the weights in turn and share[0] / share[1] of all words; no target exceeds epochs times its source's size, and
    the excess goes to the others by weight until none does.

    Filling by weight ends where every source gets least(cap, level * weight): in the order of cap / weight, the
    sources up to some place stand at their caps and the others share the rest. Sources are few and small rows; one
    task orders them.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("ord") - 1, len(weights)) + 1).cast("long")
    everything = Window.partitionBy()
    ordered = sizes.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", weight).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (ordered.withColumn("all_w", F.sum("w").over(everything)).withColumn("total", F.sum("source_size").over(everything) * share[0])
              .withColumn("cap_to", F.sum("cap").over(fill)).withColumn("w_to", F.sum("w").over(fill)))
    # level if all before this source stand at their caps, and whether this one stands below its cap at that level
    left, rest = F.col("total") - (F.col("cap_to") - F.col("cap")) * share[1], (F.col("all_w") - F.col("w_to") + F.col("w")) * share[1]
    below = left * F.col("w") < F.col("cap") * rest
    level = summed.withColumn("left", left).withColumn("rest", rest).withColumn("below", below)
    first = F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("w"), "ord", "left", "rest"))).over(everything)
    placed = level.withColumn("f", first)
    is_open = F.col("f").isNotNull() & ((F.col("cap") / F.col("w") > F.col("f.col1")) | ((F.col("cap") / F.col("w") == F.col("f.col1")) & (F.col("ord") >= F.col("f.ord"))))
    target = F.when(is_open, (F.col("f.left") * F.col("w")).cast("double") / F.col("f.rest").cast("double")).otherwise(F.col("cap").cast("double"))
    return placed.select("source", "source_size", "ord", target.alias("target"))


def _progress(share: Column, points) -> Column:
    """The progress at which a schedule's integral reaches this share of its whole."""
    parts, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        if area > 0:
            parts.append((t0, w0, (w1 - w0) / (t1 - t0), done, done + area))
            done += area
    need, out = share * done, None
    for t0, w0, slope, before, after in parts:
        more = need - before
        at = t0 + (more / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * more)) - w0) / slope)
        out = F.when(need < after, at) if out is None else out.when(need < after, at)
    return out.otherwise(F.lit(1.0))


def _when(share: Column, ord_: Column, schedules) -> Column:
    """The progress at which a source has met this share of its demand; sources take the schedules in turn."""
    turn = F.pmod(ord_ - 1, F.lit(len(schedules)))
    out = None
    for i, points in enumerate(schedules):
        out = F.when(turn == i, _progress(share, points)) if out is None else out.when(turn == i, _progress(share, points))
    return out


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, schedules=SCHEDULES, cut: bool = True,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """docs with __size, __source_size, __target, __taken (words) and __positions (one per time it is taken).

    A document's size is its number of words, or what size_col holds. Each source's documents stand in a fixed order, by the md5 of doc_id;
    its word stream runs through them up to `epochs` times and ends at the target. With cut, the last document gives
    only the words that are missing; else a document is taken whole each time that its middle lies before the end.
    Position: the progress in [0, 1] at which the source's demand, its schedule integrated and scaled to the target,
    reaches the place where the document begins.

    Running sums take two steps: within a 4096th of a source's order, then over the parts; so a source that holds most
    rows is never summed by one task. Reruns give the same rows.

    Null and empty texts have size 0 and are taken 0 words, with no position. A null source is a source of its own, the
    last in order. Rows without a doc_id stand in the order by the md5 of their text in its place. Rows that repeat a doc_id
    and a text are alike: their order doesn't matter. One task sums the rows of one doc_id (or, without it, of one text), so ids should be
    nearly distinct. Other columns pass through; the columns beginning with two underscores are reserved. An empty table
    gives an empty table.
    """
    by_text = [F.concat(F.lit("text:"), F.col(text_col))] if text_col in docs.columns else []
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), *by_text, F.lit("")))
    # with texts to carry, words are counted for the parts and again for the rows: that costs CPU, a copy of all texts disk
    counted = docs.withColumn("__size", n_words(F.col(text_col))) if size_col is None else docs.withColumnRenamed(size_col, "__size")
    sized = counted.withColumn("__key", key).withColumn("__part", F.substring("__key", 1, 3))
    parts = sized.groupBy(F.col(source_col).alias("source"), F.col("__part").alias("part")).agg(F.sum("__size").alias("words"))
    offsets = parts.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    frame = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(offsets["source"].alias("__s"), F.col("part").alias("__p"), F.coalesce("before", F.lit(0)).alias("__before"), F.col("source_size").alias("__source_size"), F.col("ord").alias("__ord"), F.col("target").alias("__target"))
    within = Window.partitionBy(source_col, "__part").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    both = running.join(frame, running[source_col].eqNullSafe(frame["__s"]) & (F.col("__part") == F.col("__p")), "left")
    end = F.floor("__target").cast("long")
    begin = F.col("__before") + F.col("__within")
    times, taken = [], None
    for epoch in range(epochs):
        at = begin + F.col("__source_size") * epoch
        here = F.greatest(F.lit(0), F.least(F.col("__size"), end - at)) if cut else F.when(at * 2 + F.col("__size") < end * 2, F.col("__size")).otherwise(0)
        taken = here if taken is None else taken + here
        times.append(F.when(here > 0, _when(at.cast("double") / end, F.col("__ord"), schedules)))
    out = both.withColumn("__taken", taken.cast("long")).withColumn("__positions", F.array_compact(F.array(*times)))
    return out.drop("__key", "__part", "__within", "__s", "__p", "__before", "__ord")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken, range-sorted by its position (column __position)."""
    rows = mixed.withColumn("__position", F.explode("__positions")).drop("__positions")
    return rows.sort("__position")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when: the progress in [0, 1] at which each of its takings begins, null if
    there is none. In the order of the first one, documents that are not taken last."""
    unnamed = F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")  # rows without a doc_id are told apart by it
    sizes = stash(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"), unnamed), "sizes")
    out = curriculum(sizes, size_col="n")
    rows = out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"),
                      F.get("__positions", F.lit(0)).alias("first_position"), F.get("__positions", F.lit(1)).alias("second_position"))
    return rows.sort(F.asc_nulls_last("first_position"), "doc_id")


def _schedule_sql(begin: str) -> str:
    """The three schedules inverted in SQL, at the share begin / e of a source's demand."""
    share = f"(CAST({begin} AS DOUBLE) / e)"
    fade = lambda w0, slope: f"CASE WHEN {share} < 1.0 THEN 0.0::DOUBLE + (sqrt(greatest(0.0, {w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {share})) - {w0}::DOUBLE) / {slope}::DOUBLE ELSE 1.0 END"
    return f"CASE (ord - 1) % 3 WHEN 0 THEN least({share}, 1.0) WHEN 1 THEN {fade(0.5, 1.0)} ELSE {fade(1.5, -1.0)} END"


OP5_SQL = """
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                  coalesce(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT), 0) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM d GROUP BY source),
     w AS (SELECT *, [3, 1, 2][(ord - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
     l AS (SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rem,
                  2 * (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS den,
                  row_number() OVER f AS fill FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, ord)),
     b AS (SELECT fill AS from_fill, rem, den FROM l WHERE rem * w < cap * den ORDER BY fill LIMIT 1),
     t AS (SELECT source, source_size, ord, CASE WHEN fill >= from_fill THEN CAST(b.rem * w AS DOUBLE) / CAST(b.den AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
           FROM l LEFT JOIN b ON true),
     r AS (SELECT d.doc_id, d.size, t.source_size, t.ord, t.target, CAST(floor(t.target) AS BIGINT) AS e,
                  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, e - before)) + greatest(0, least(size, e - before - source_size)) AS BIGINT) AS taken,
       CASE WHEN least(size, e - before) > 0 THEN {first} WHEN least(size, e - before - source_size) > 0 THEN {second} END AS first_position,
       CASE WHEN least(size, e - before) > 0 AND least(size, e - before - source_size) > 0 THEN {second} END AS second_position FROM r
""".replace("{first}", _schedule_sql("before")).replace("{second}", _schedule_sql("before + source_size"))
