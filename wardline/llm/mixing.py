"""Mixing sources to target weights: capped water-filling, then a seeded
choice of whole and fractional repetitions.  DataFrame expressions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Hex digits of the draw that make a bucket: 16 ** 3 buckets per source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> with ``weight`` and ``target``.

    Sources in code-point order, null last, take the weights in turn.  They
    share ``share`` times all sizes in proportion to the weights; no target
    exceeds ``max_epochs`` times its size, and what a capped source leaves goes
    to the others by weight.  That is target = min(cap, level * weight) with
    one common level: with sources by rising cap / weight, the level is what
    remains after the first j caps over the remaining weights, for the first j
    whose next source is not capped by it.  One row per source; the windows
    hold the list of sources, never documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sources.withColumn("nth", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("nth") % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_cap = Window.orderBy("ratio", "nth")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("cap").over(every)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(every)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts words, repeats included.  A source of target t and size s
    takes every document floor(t / s) times; the words still missing come from
    documents in the order of a seeded digest of their id, the last of them in
    part, so a source's taken words are its target rounded down.  With caps of
    2 no document exceeds twice its size.

    The order needs no sort of a source: documents are first summed into
    buckets by the leading digits of their draw, running sums over buckets
    (4,096 per source) settle all but the bucket where the budget ends, and
    only that bucket's documents are ranked.

    A null text has size 0; null sources form one source; null or repeated ids
    share a draw and are ordered by size; a table without words, or an empty
    one, takes nothing."""
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("draw")), "sizes")
    sized = sized.withColumn("bucket", F.conv(F.substring("draw", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    buckets = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")),
                         weights=weights, share=share, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = (targets.withColumn("whole", whole.cast("long"))
               .withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
               .select(F.col("source").alias("of"), "source_size", "target", "whole", "rest"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (buckets.join(targets, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(running), F.lit(0)))
            .select("of", F.col("bucket").alias("at"), "words", "source_size", "target", "whole", "left"))
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    ends_here = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    out = ["doc_id", "source", "size", "source_size", "target"]
    clear = dealt.where(~ends_here).select(
        *out, (F.col("whole") * F.col("size") + F.when(F.col("left") > 0, F.col("size")).otherwise(0)).alias("taken"))
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where(ends_here).withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.select(*out, (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least("size", "left"))).alias("taken"))
    return clear.unionByName(last)


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken, the last copy
    cut after the words that are taken of it.  ``mixed`` has the columns
    ``doc_id, size, taken`` of ``mix``; columns stay those of ``docs``, whatever
    their names.  Rows that repeat an id are told apart by their sizes; if these
    are equal too, each is taken as often as the one that is taken most."""
    mark = uuid.uuid4().hex
    of, size, taken, copy = (f"{c}-{mark}" for c in ("of", "size", "taken", "copy"))
    col = lambda name: F.col(f"`{name}`")
    m = (mixed.where(F.col("taken") > 0).groupBy(F.col("doc_id").alias(of), F.col("size").alias(size))
         .agg(F.max("taken").alias(taken)))
    copies = F.sequence(F.lit(1), F.ceil(col(taken) / col(size)).cast("int"))
    rest = F.least(col(size), col(taken) - (col(copy) - 1) * col(size)).cast("int")
    cut = F.array_join(F.slice(F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1),
                               rest + F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)), "")
    same = F.col("doc_id").eqNullSafe(col(of)) & (n_words(F.col("text")) == col(size))
    rows = docs.join(m, same).withColumn(copy, F.explode(copies))
    text = F.when(rest < col(size), cut).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*[col(c) for c in docs.columns])
