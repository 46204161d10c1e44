"""Fusion of two models, the decision, and the re-ranking by text and by matched points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch import config as C
from labelmatch.functions.storage import written
from labelmatch.functions.vectors import average_views
from labelmatch.operators.retrieve import max_similarity_by_product, nearest_products


def fuse(candidates: DataFrame, sims: DataFrame, views: DataFrame | list[int], weight: float = C.SECOND_WEIGHT) -> DataFrame:
    """``sims(query_id, product_id, model, view, similarity)``: model A is the second, by ``weight``; B the first.

    ``views`` are the views of every query, or ``(query_id, n_views)``. A view of a candidate without a similarity counts
    MISSING_SIMILARITY; a query without any similarity of B is ranked by A alone. Order is by the unrounded sum, then the product id as text.
    """
    of = lambda m: F.when(F.col("model") == m, F.col("similarity"))
    cells = [f(of(m)).alias(f"{n}_{m.lower()}") for m in "AB" for f, n in ((F.sum, "sum"), (F.count, "n"), (F.max, "best"))]
    wide = sims.groupBy("query_id", "product_id").agg(*cells)
    joined = candidates.select("query_id", "product_id").join(wide, ["query_id", "product_id"], "left")
    joined = joined.withColumn("n_views", F.lit(len(views))) if isinstance(views, list) else joined.join(views.select("query_id", "n_views"), "query_id")
    total = lambda m: F.coalesce(f"sum_{m}", F.lit(0.0)) + C.MISSING_SIMILARITY * (F.col("n_views") - F.coalesce(f"n_{m}", F.lit(0)))
    has_b = F.max(F.coalesce("n_b", F.lit(0))).over(Window.partitionBy("query_id")) > 0
    fused = joined.withColumn("fusion_raw", F.when(has_b, total("b")).otherwise(0.0) + weight * total("a"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_raw"), F.col("product_id").cast("string"))
    out = fused.withColumn("rank", F.row_number().over(order))
    return out.select("query_id", "product_id", "rank", F.round("fusion_raw", 4).alias("fusion"), F.round("best_a", 4).alias("best_a"), F.round("best_b", 4).alias("best_b"))


def classify(similarity: Column, margin: Column, found: float = C.FOUND_SIMILARITY, gap: float = C.FOUND_MARGIN, reject: float = C.REJECT_BELOW) -> Column:
    """found, probable or not_in_catalog; without a similarity probable, without a margin an infinite one."""
    C.check_thresholds(reject, found)
    sure = (similarity >= found) & F.coalesce(margin >= gap, F.lit(True))
    return F.when(similarity.isNull(), "probable").when(similarity < reject, "not_in_catalog").when(sure, "found").otherwise("probable")


def reason(similarity: Column, margin: Column, found: float = C.FOUND_SIMILARITY, gap: float = C.FOUND_MARGIN, reject: float = C.REJECT_BELOW) -> Column:
    low = F.when(similarity < found, "similarity below found").otherwise("margin too small")
    return F.when(similarity.isNull(), "no similarity").when(similarity < reject, "similarity below reject").when(classify(similarity, margin, found, gap, reject) == "found", "similarity and margin").otherwise(low)


def answers(ranked: DataFrame, queries: DataFrame, found: float, gap: float, reject: float, predict_threshold: float | None = None) -> DataFrame:
    """One row for each query: winner, similarity, margin of the rounded sums, status, reason; without candidates not_in_catalog."""
    margin = F.round(F.col("fusion") - F.lead("fusion").over(Window.partitionBy("query_id").orderBy("rank")), 4)
    first = ranked.withColumn("margin", margin).where("rank = 1").withColumn("similarity", F.coalesce("best_b", "best_a"))
    status = classify(F.col("similarity"), F.col("margin"), found, gap, reject)
    if predict_threshold is not None:
        status = F.when(F.col("similarity") < predict_threshold, "not_in_catalog").otherwise(status)
    joined = queries.select("query_id").distinct().join(first, "query_id", "left")
    joined = joined.withColumn("status", F.when(F.col("product_id").isNull(), "not_in_catalog").otherwise(status))
    winner = F.when(F.col("status") != "not_in_catalog", F.col("product_id"))
    why = F.when(F.col("product_id").isNull(), "no candidates").otherwise(reason(F.col("similarity"), F.col("margin"), found, gap, reject))
    return joined.select("query_id", winner.alias("winner"), "status", "fusion", "margin", F.col("similarity").alias("confidence"), why.alias("reason"))


def cascade(queries: DataFrame, refs_a: DataFrame, refs_b: DataFrame, k: int = C.TOP_K, pool: int = C.POOL, weight: float = C.SECOND_WEIGHT, without: DataFrame | None = None) -> DataFrame:
    """``queries(query_id, view, model, vec)`` -> ranked candidates: A's averaged view finds the pool, both models score all its views.

    Products of ``without(query_id, product_id)`` are no candidates of that query.
    """
    mean = average_views(queries.where("model = 'A'").select("query_id", "vec"), "query_id", "vec")
    pool_rows = written(nearest_products(mean, refs_a, max(k, pool), without).select("query_id", "product_id"), "cascade-pool")
    refs = refs_a.select("product_id", "vector_id", "vec", F.lit("A").alias("model")).unionByName(refs_b.select("product_id", "vector_id", "vec", F.lit("B").alias("model")))
    sims = max_similarity_by_product(queries, refs, pool_rows, ["model"], ["view"])
    return fuse(pool_rows, sims, queries.groupBy("query_id").agg(F.countDistinct("view").alias("n_views")), weight)


def predict_top1(found: DataFrame) -> DataFrame:
    """Two statuses: probable counts as found."""
    status = F.when(F.col("status") == "not_in_catalog", "not_in_catalog").otherwise("found")
    return found.select("query_id", status.alias("status"), "winner")


#: A vintage is 1800 to 2029; words have two characters or more.
VINTAGE = r"\b(1[89]\d{2}|20[012]\d)\b"
TOKEN = "[a-zа-яё0-9]{2,}"


def vintage(text: Column) -> Column:
    year = F.regexp_extract(F.coalesce(text, F.lit("")), VINTAGE, 1)
    return F.when(year != "", year.cast("int"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def text_score(similarity: Column, query: Column, title: Column, description: Column) -> Column:
    """similarity, same vintage, and Jaccard of the words, by TEXT_WEIGHTS."""
    text = F.concat_ws(" ", description, title)
    a, b = tokens(query), tokens(text)
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    shared = F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.greatest(every, F.lit(1))).otherwise(0.0)
    same = F.when(F.coalesce(vintage(query) == vintage(text), F.lit(False)), 1.0).otherwise(0.0)
    w = C.TEXT_WEIGHTS
    return w[0] * similarity + w[1] * same + w[2] * shared


def rerank_by_text(candidates: DataFrame, k: int) -> DataFrame:
    """``candidates(query_id, product_id, rank, similarity, query_text, title, description)``: the first k anew, ties by the old rank; the rest as they are."""
    scored = candidates.withColumn("text_score", text_score(F.col("similarity"), F.col("query_text"), F.col("title"), F.col("description")))
    head = F.col("rank") <= k
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col("text_score")).otherwise(F.lit(0.0)), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))


def evidence_score(similarity: Column, good: Column, inliers: Column) -> Column:
    w = C.EVIDENCE_WEIGHTS
    more = w[1] * F.least(F.lit(1.0), inliers / C.EVIDENCE_INLIERS) + w[2] * inliers / F.greatest(F.lit(1), good)
    return w[0] * similarity + F.coalesce(more, F.lit(0.0))


def rerank_by_match_evidence(candidates: DataFrame, gate: float | None = None) -> DataFrame:
    """``candidates(query_id, product_id, rank, similarity, good, inliers)``; with a gate, only where the first similarity reaches it."""
    scored = candidates.withColumn("evidence", evidence_score(F.col("similarity"), F.col("good"), F.col("inliers")))
    if gate is not None:
        first = F.max(F.when(F.col("rank") == 1, F.col("similarity"))).over(Window.partitionBy("query_id"))
        scored = scored.withColumn("key", F.when(first >= gate, -F.col("evidence")).otherwise(F.lit(0.0)))
    else:
        scored = scored.withColumn("key", -F.col("evidence"))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("key", "rank"))).drop("key")


def ratio_test(matches: DataFrame) -> DataFrame:
    """``matches(query_id, product_id, d1, d2)`` -> good matches of each pair; fewer than LEAST_MATCHES count no inliers."""
    good = F.count(F.when(F.col("d2").isNotNull() & (F.col("d1") < C.RATIO * F.col("d2")), 1))
    return matches.groupBy("query_id", "product_id").agg(good.alias("good")).withColumn("usable", F.col("good") >= C.LEAST_MATCHES)


def threshold_errors(settings: DataFrame) -> DataFrame:
    """``settings(name, reject_below, found_similarity)`` -> ``(name, error)`` of those that ``config.check_thresholds`` would refuse, or that lack a bound.

    A zone of rejection that just meets the zone of acceptance is allowed; NaN is a bound that is missing.
    """
    low, high = (F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("reject_below", "found_similarity"))
    error = F.when(low.isNull() | high.isNull(), "missing").when(low > high, "exceeds")
    return settings.select("name", error.alias("error")).where("error is not null")
