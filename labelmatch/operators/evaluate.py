"""Reports on predictions: hits, zones, latencies by index rules, comparisons, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch import config as C
from labelmatch.operators.decide import cascade, classify


def hit_at_1(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """``predictions(query_id, predicted, latency_ms)``, ``truth(query_id, expected)``: one row of counts; a line without truth is a miss."""
    joined = predictions.join(truth, "query_id", "left")
    hit = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    return joined.agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


def demote_unknown(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """``labels(query_id, kind, accepted array)``: accepted slugs the catalog lacks go; kind ``in`` without any becomes ``out``."""
    known = labels.select("query_id", F.explode("accepted").alias("slug")).join(catalog.select("slug").distinct(), "slug", "left_semi")
    kept = known.groupBy("query_id").agg(F.sort_array(F.collect_set("slug")).alias("accepted"))
    out = labels.drop("accepted").join(kept, "query_id", "left")
    return out.withColumn("kind", F.when((F.col("kind") == "in") & F.col("accepted").isNull(), "out").otherwise(F.col("kind")))


def at_index(df: DataFrame, group: list[str], value: str, index: Column, to: str) -> DataFrame:
    """The value at a zero-based index of the sorted values of each group; ``index`` may use the count ``n``.

    Equal values of a group are counted first, so that a group of any size is sorted as its distinct values.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias(to)).count()
    every = Window.partitionBy(*group)
    ordered = each.withColumn("upto", F.sum("count").over(every.orderBy(to).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("count").over(every))
    return ordered.where(F.col("upto") > index).groupBy(*group).agg(F.min(to).alias(to))


def p95_index() -> Column:
    return F.greatest(F.lit(0), F.floor(0.95 * F.col("n")).cast("int") - 1)


def upper_median_index() -> Column:
    return F.floor(F.col("n") / 2).cast("int")


def recognition_report(rows: DataFrame) -> DataFrame:
    """``rows(set, kind in|out, status, correct, latency_ms)`` -> a row for each set and one for ALL.

    Of what is in the catalog: how many, right first answers, zones (``in_rejected`` are the wrong rejects), right ones among
    the found; of what is not: zones. Latencies: the median, p95 by its index rule, and the largest.
    """
    inside, out = F.col("kind") == "in", F.col("kind") == "out"
    status = lambda side, s: F.count_if(side & (F.col("status") == s))
    counts = rows.rollup("set").agg(
        F.count_if(inside).alias("n_in"),
        F.count_if(inside & F.col("correct")).alias("top1"),
        status(inside, "found").alias("in_found"),
        status(inside, "probable").alias("in_probable"),
        status(inside, "not_in_catalog").alias("in_rejected"),
        F.count_if(inside & (F.col("status") == "found") & F.col("correct")).alias("found_correct"),
        status(out, "found").alias("out_found"),
        status(out, "probable").alias("out_probable"),
        status(out, "not_in_catalog").alias("out_rejected"),
        F.median("latency_ms").alias("median_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
    both = rows.select(F.explode(F.array("set", F.lit("ALL"))).alias("set"), "latency_ms")
    p95 = at_index(both, ["set"], "latency_ms", p95_index(), "p95_ms")
    return counts.withColumn("set", F.coalesce("set", F.lit("ALL"))).join(p95, "set", "left")


def pooled_totals(packs: DataFrame) -> DataFrame:
    """``packs(correct, total, avg_ms)``: sums, and latency weighted by the totals."""
    return packs.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.round(F.sum(F.col("avg_ms") * F.col("total")) / F.sum("total"), 4).alias("avg_ms"))


def evaluate_pack(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Detail by query id: the last line of a repeated id, whether it is right, and how many lines there were."""
    last = predictions.groupBy("query_id").agg(F.max(F.struct("line", "predicted")).alias("l"), F.count("*").alias("lines"))
    joined = last.join(truth, "query_id", "left")
    return joined.select("query_id", F.col("l.predicted").alias("predicted"), "expected", F.coalesce(F.col("l.predicted") == F.col("expected"), F.lit(False)).alias("correct"), "lines")


def diff_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """``(query_id, change)``: fixed, broken, still failing, same, added or missing."""
    both = base.select("query_id", F.col("correct").alias("a")).join(other.select("query_id", F.col("correct").alias("b")), "query_id", "full_outer")
    a, b = F.col("a"), F.col("b")
    change = F.when(a.isNull(), "added").when(b.isNull(), "missing").when(~a & b, "fixed").when(a & ~b, "broken").when(~a & ~b, "still failing").otherwise("same")
    return both.select("query_id", change.alias("change"))


def replay(queries: DataFrame, refs_a: DataFrame, refs_b: DataFrame, labels: DataFrame, found: float, gap: float, reject: float, pool: int = C.POOL, weight: float = C.SECOND_WEIGHT) -> DataFrame:
    """``(query_id, kind, similarity, status, correct)``: the cascade's answers to labelled queries, once as they are and once without their own products.

    ``labels(query_id, kind in|out, accepted)``, ``accepted`` holding the products that are right. Queries of kind in with a product are
    ``positive``, and ``left_out`` with these products taken out of their pools; the others are ``negative``. A query left without candidates is not_in_catalog.
    """
    known = labels.where((F.col("kind") == "in") & (F.size("accepted") > 0)).select("query_id", "accepted")
    own = known.select("query_id", F.explode("accepted").alias("product_id")).distinct()
    kinds = labels.where("kind in ('in', 'out')").join(known.select("query_id", F.lit("positive").alias("positive")), "query_id", "left").select("query_id", F.coalesce("positive", F.lit("negative")).alias("kind"), "accepted")
    out = None
    for asked, without in ((queries.join(kinds, "query_id", "left_semi"), None), (queries.join(known, "query_id", "left_semi"), own)):
        ranked = cascade(asked, refs_a, refs_b, pool=pool, weight=weight, without=without)
        margin = F.round(F.col("fusion") - F.lead("fusion").over(Window.partitionBy("query_id").orderBy("rank")), 4)
        first = asked.select("query_id").distinct().join(kinds, "query_id").join(ranked.withColumn("margin", margin).where("rank = 1"), "query_id", "left")
        similarity = F.coalesce("best_b", "best_a")
        kind = F.col("kind") if without is None else F.lit("left_out")
        part = first.select("query_id", kind.alias("kind"), similarity.alias("similarity"), F.when(F.col("product_id").isNull(), "not_in_catalog").otherwise(classify(similarity, F.col("margin"), found, gap, reject)).alias("status"), F.coalesce(F.array_contains("accepted", F.col("product_id")), F.lit(False)).alias("correct"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(scored: DataFrame, safety: float = C.SAFETY) -> DataFrame:
    """``scored(kind positive|negative|left_out, similarity, status)``, as of ``replay`` -> zone counts and the bounds that follow.

    Rejection stays below every positive, acceptance above every real negative, each by ``safety``.
    """
    low = F.min(F.when(F.col("kind") == "positive", F.col("similarity"))) - safety
    high = F.max(F.when(F.col("kind") == "negative", F.col("similarity"))) + safety
    zones = [F.count_if((F.col("kind") == k) & (F.col("status") == s)).alias(f"{k}_{s}") for k in ("positive", "negative", "left_out") for s in ("found", "probable", "not_in_catalog")]
    return scored.agg(*zones, F.round(low, 4).alias("reject_at_most"), F.round(high, 4).alias("found_at_least"))


def batch_summary(answers: DataFrame) -> DataFrame:
    """``answers(status, error, latency_ms)``: counts by status, errors, and the upper median latency."""
    counts = answers.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("found", "probable", "not_in_catalog")], F.count("error").alias("errors"))
    return counts.crossJoin(value_at(answers, "latency_ms", upper_median_index(), "median_ms"))


def value_at(df: DataFrame, value: str, index: Column, to: str) -> DataFrame:
    """One row: the value at a zero-based index of all sorted values; what is sorted in one task are distinct values (milliseconds, levels, counts)."""
    return at_index(df.select(F.lit(1).alias("_all"), value), ["_all"], value, index, to).agg(F.min(to).alias(to))


def confusable_pairs(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Wrong first answers whose true product stands second: ``(expected, taken_for, n)``."""
    joined = ranked.join(truth, "query_id")
    first = joined.where("rank = 1 and product_id <> expected").select("query_id", "expected", F.col("product_id").alias("taken_for"))
    second = joined.where("rank = 2 and product_id = expected").select("query_id")
    return first.join(second, "query_id", "left_semi").groupBy("expected", "taken_for").agg(F.count("*").alias("n"))


def recall_at_pool(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """How many queries there are, and how many have their true product in their list."""
    hits = ranked.join(truth.withColumnRenamed("expected", "product_id"), ["query_id", "product_id"], "left_semi").agg(F.countDistinct("query_id").alias("hits"))
    return truth.agg(F.count("*").alias("n")).crossJoin(hits).withColumn("recall", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 4))
