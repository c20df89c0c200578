"""Mixing sources to target token counts by entropy balancing, from built-in functions only.

Document rates r minimise the sum of r ln r - r + 1 subject to each source's tokens, sum(r t) = T, and r <= cap. The
solution is r = min(cap, exp(lambda t)) with one lambda per source, which Newton steps on the convex dual find: each
step sums, in parallel and per source, the tokens and their derivative over the histogram of document sizes. A bracket
keeps steps from overshooting. The rates become whole copies: classes of equal size get a whole number of copies, and
what rounding leaves of a source's target is taken up by one class after another, the largest that fits first.

Scale: documents are shuffled as (id, source, size) only. A histogram has a row per source and distinct size. Classes
that hold a thousandth of all documents or more are split by a hash of the id, so that no task ranks a hot class alone.

Defined cases: a null text has size 0 and is never taken. A null source is a source of its own, the last. Equal rows
are mixed each. A source without words has target 0. Reruns agree: nothing depends on partitions or their order.
An empty table gives no rows. Columns other than id, source and text, of any name, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import HOT_SHARE, global_rank, hash_unit, join_hot, materialize
from factloom.llm.quality_rules import words

#: Newton's step is taken where it stays in the bracket and the step before left at most this share of the gap. Otherwise
#: the bracket is halved or, while it is open to that side, the tilt doubled, so that the steps come to an end.
FAST = 0.5
#: The bracket's first ends.
OPEN = 1e6
#: Passes over the classes between two looks at what is left.
PASSES = 3
#: A gap of less than this share of the target, or of less than a word, is left.
NEAR = 0.001


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: weights share ``share`` times all sizes, none gets over ``cap`` times its size.

    The excess goes to the others by weight until none is above; each round reads two sums.
    """
    sums = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = share * (sums["size"] or 0)
    level = wanted / sums["weight"] if sums["weight"] else 0.0
    most = F.col("source_size") * cap
    while True:
        above = F.col("weight") * F.lit(level) > most
        x = sources.agg(F.sum(F.when(above, most)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        new = (wanted - (x["full"] or 0.0)) / x["weight"] if x["weight"] else math.inf
        if not x["weight"] or new <= level * (1 + 1e-15):
            break
        level = new
    return sources.withColumn("target", most if math.isinf(new) else F.least(most, F.col("weight") * F.lit(level)).cast("double"))


def solve_dual(histogram: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Per source key: ``lam``, such that the tilted rates min(cap, exp(lam * size / mean size)) take its target."""
    state = materialize(
        sources.filter("source_size > 0").select(
            "_key", "target", F.col("source_size").cast("double").alias("total"), (F.col("source_size") / F.col("_words_n")).alias("mean"),
            F.lit(0.0).alias("lam"), F.lit(-OPEN).alias("low"), F.lit(OPEN).alias("high"), F.lit(1e300).alias("last"),
        ).withColumn("done", F.col("target") >= F.col("total") * cap * (1 - 1e-12))
        .withColumn("lam", F.when(F.col("done"), 1e9).otherwise(F.col("lam")))
    )
    while not state.filter(~F.col("done")).isEmpty():
        x = F.col("lam") * F.col("size") / F.col("mean")
        free = x < math.log(cap)
        tokens = F.col("n") * F.col("size") * tilted(x, cap)
        sums = (
            histogram.join(state.filter(~F.col("done")).select("_key", "lam", "mean"), "_key")
            .groupBy("_key").agg(F.sum(tokens).alias("tokens"), F.sum(F.when(free, tokens * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("tokens") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        ready = (F.abs(gap) <= F.greatest(F.lit(0.01), F.col("total") * 1e-9)) | (high - low <= 1e-12 * F.greatest(F.abs(low), F.abs(high)))
        fast, twice = F.abs(gap) <= FAST * F.col("last"), 2 * F.abs("lam") + 1
        moved = (
            F.when(ready, F.col("lam")).when(fast & (step > low) & (step < high), step)
            .when((gap < 0) & (high >= OPEN) & (twice < OPEN), twice).when((gap > 0) & (low <= -OPEN) & (twice < OPEN), -twice).otherwise((low + high) / 2)
        )
        stepped = state.join(sums, "_key", "left").select(
            "_key", "target", "total", "mean",
            F.when(F.col("tokens").isNull(), F.col("lam")).otherwise(moved).alias("lam"),
            F.coalesce(low, F.col("low")).alias("low"), F.coalesce(high, F.col("high")).alias("high"), F.coalesce(F.abs(gap), F.col("last")).alias("last"),
            (F.col("done") | F.coalesce(ready, F.lit(True))).alias("done"),
        )
        state = materialize(stepped)
    return state.select("_key", "lam", "mean")


def tilted(exponent: Column, cap: float) -> Column:
    """min(cap, exp(exponent)), without overflow."""
    return F.when(exponent >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(F.least(exponent, F.lit(math.log(cap)))))


def take_up(out: DataFrame, copies: str, rest: str, cap: int) -> DataFrame:
    """Passes over the classes of each source, the largest first, that take up what is left (``rest``) by what fits; the
    last one's takes are in ``_take``."""
    by_key = Window.partitionBy("_key")
    before = by_key.orderBy(F.desc("size"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(PASSES):
        more = F.col(rest) > 0
        room = F.when(more, F.col("n") * cap - F.col(copies)).otherwise(F.col(copies))
        out = out.withColumn("_room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs(rest)), room).otherwise(F.lit(0)))
        ahead = F.coalesce(F.sum(F.col("_room") * F.col("size")).over(before), F.lit(0))
        take = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor((F.abs(rest) - ahead) / F.greatest("size", F.lit(1)))))
        out = out.withColumn("_take", F.when(more, take).otherwise(-take).cast("long"))
        out = out.withColumns({copies: F.col(copies) + F.col("_take"), rest: F.col(rest) - F.sum(F.col("_take") * F.col("size")).over(by_key)})
    return out.drop("_room")


def round_classes(classes: DataFrame, cap: int) -> DataFrame:
    """Add ``copies`` (of all the class's documents together) to classes (_key, target, size, salt, n, rate).

    What rounding leaves of a target is taken up by what fits. Where nothing fits, one copy that is too much is tried and
    what it exceeds the target by is taken back; it stays if a tenth of the gap is gained, so that the rounds come to an
    end, and no more is tried once the gap is below NEAR. A source has as many classes as distinct sizes, and at most HOT_SHARE more.
    """
    by_key = Window.partitionBy("_key")
    draw = hash_unit("_key", "size", "salt", seed=9)
    out = classes.withColumn("copies", F.least(F.floor(F.col("n") * F.col("rate") + draw), F.col("n") * cap).cast("long"))
    out = out.withColumn("_rest", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(by_key))
    while True:
        out = materialize(take_up(out, "copies", "_rest", cap).withColumnRenamed("_take", "_last"))
        room = F.when(F.col("_rest") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        gap = F.when((room > 0) & (F.col("size") > 0), F.abs(F.col("size") - F.abs("_rest")))
        open_gap = F.abs("_rest") >= F.greatest(F.lit(1.0), F.col("target") * NEAR)
        nearest = F.row_number().over(by_key.orderBy(F.coalesce(gap, F.lit(math.inf)), "size", "salt")) == 1
        one = F.when(nearest & gap.isNotNull() & open_gap, F.signum("_rest")).otherwise(F.lit(0)).cast("long")
        trial = out.withColumn("_one", one).withColumns({
            "_copies": F.col("copies") + F.col("_one"), "_left": F.col("_rest") - F.sum(F.col("_one") * F.col("size")).over(by_key)})
        trial = take_up(trial, "_copies", "_left", cap)
        better = F.abs("_left") <= 0.9 * F.abs("_rest")
        trial = trial.withColumn("_better", better & open_gap).withColumns({
            "copies": F.when(F.col("_better"), F.col("_copies")).otherwise(F.col("copies")), "_rest": F.when(F.col("_better"), F.col("_left")).otherwise(F.col("_rest"))})
        trial = materialize(trial.drop("_one", "_copies", "_left", "_take"))
        if trial.filter("_better or _last != 0").isEmpty():
            return trial.drop("_rest", "_last", "_better")
        out = trial.drop("_last", "_better")


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, row: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken (words, repeats counted) and ``row``, if given."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = materialize(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source).alias("source"), key.alias("_key"), F.size(words(F.col(text))).cast("long").alias("size"),
        *([] if row is None else [F.col(row).alias("_row_")])))
    histogram = materialize(sized.groupBy("_key", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("_key").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("_n"),
        F.greatest(F.lit(1), F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("_words_n"))
    # the null source's key is "n"; others' keys begin with "s", and bytes order as code points
    ranked = global_rank(sources.withColumn("_last", F.col("_key") == "n"), ["_last", "_key"], "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialize(water_fill(materialize(ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")))), share, cap))
    dual = solve_dual(histogram.filter("size > 0"), sources, cap)

    total = sources.agg(F.sum("_n")).first()[0] or 0
    # classes with many documents, at most HOT_SHARE of them, are split
    hot = histogram.filter(F.col("n") * HOT_SHARE >= total).select(
        "_key", "size", F.greatest(F.lit(1), F.ceil(F.col("n") * HOT_SHARE / max(1, total))).cast("long").alias("_parts"))
    salted = sized.join(F.broadcast(hot), ["_key", "size"], "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_parts")), F.lit(0)).cast("long")).drop("_parts")
    per_source = materialize(sources.join(dual, "_key", "left").select("_key", "source_size", "target", "lam", "mean"))
    rate = F.coalesce(tilted(F.col("lam") * F.col("size") / F.col("mean"), cap), F.lit(0.0))
    classes = salted.groupBy("_key", "size", "salt").agg(F.count("*").alias("n")).join(per_source, "_key").withColumn("rate", rate)
    rounded = materialize(round_classes(classes, cap).select("_key", "size", "salt", "n", "source_size", "target", "rate", "copies"))
    nth = F.row_number().over(Window.partitionBy("_key", "size", "salt").orderBy(hash_unit("doc_id", seed=10), "doc_id"))
    whole = F.floor(F.col("copies") / F.col("n"))
    per_doc = (whole + (F.col("_nth") <= F.col("copies") - whole * F.col("n")).cast("long")).cast("long")
    return (
        salted.withColumn("_nth", nth).join(rounded, ["_key", "size", "salt"])
        .select("doc_id", "source", "size", "source_size", "target", "rate", per_doc.alias("copies"), (per_doc * F.col("size")).alias("taken"),
                *([] if row is None else [F.col("_row_").alias(row)]))
    )
