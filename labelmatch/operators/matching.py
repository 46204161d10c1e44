"""Requests against products: filters with reasons, scored rules, ranking, and what follows from them.

``requests(request_id, axes struct, tags, region, course, colors, sparkling, sweet_ok, grapes_like, grapes_avoid,
avoid_oak, tannin_pref, body_pref, regions, occasion, excluded_ids)``; unset wishes are null or empty.
``products(product_id, ord, name, category, region, winery, grapes, sweetness, sparkling, acidity, tannin, body,
oak, aroma, food)``. Every request meets every product, which is the question asked; requests are the small side
and are broadcast only if their number is within MAX_REQUESTS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.config import RULES
from labelmatch.functions.storage import written
from labelmatch.llm.lists import deal, sides, walk
from labelmatch.operators.evaluate import upper_median_index, value_at
from labelmatch.operators.requests import aroma_links, dish_food_tags

MAX_REQUESTS, RARE, CLASSIC_SHARE, HEAD, FLOOR, SPREAD = 10_000, 8, 0.85, 120, 15.0, 25.0


def pairs(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Columns ``r`` and ``p`` of each request with each product."""
    r = requests.select(F.struct("*").alias("r"))
    small = r.limit(MAX_REQUESTS + 1).count() <= MAX_REQUESTS
    return products.select(F.struct("*").alias("p")).crossJoin(F.broadcast(r) if small else r)


def grape_counts(products: DataFrame) -> DataFrame:
    """``(grape, n)``: in how many products each grape is named."""
    return products.select(F.explode("grapes").alias("grape")).groupBy("grape").agg(F.count("*").alias("n"))


def catalog_stats(products: DataFrame) -> DataFrame:
    """One row: ``classic`` (the count at 85 % of the grapes' sorted counts), ``red_tannin`` (upper median of the red ones), ``n_grapes``.

    Both are read off counts of equal values, so nothing sorts all grapes or all products in one task.
    """
    counts = grape_counts(products)
    reds = products.where("category = 'Красное' and tannin is not null")
    classic = value_at(counts, "n", F.floor(F.col("n") * CLASSIC_SHARE), "classic")
    return classic.crossJoin(value_at(reds, "tannin", upper_median_index(), "red_tannin")).crossJoin(counts.agg(F.count("*").alias("n_grapes")))


def with_common(products: DataFrame) -> DataFrame:
    """``products`` and ``common``: how often the most frequent of its grapes is named in the catalog; null without grapes."""
    own = products.select("product_id", F.explode("grapes").alias("grape")).join(grape_counts(products), "grape").groupBy("product_id").agg(F.max("n").alias("common"))
    return products.join(own, "product_id", "left")


def drop_reason(r: Column, p: Column) -> Column:
    """The first reason, in order, why a product is not offered; null if it is."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return (
        F.when(F.coalesce(F.array_contains(r["excluded_ids"], p["product_id"]), F.lit(False)), "excluded")
        .when(some(r["colors"]) & ~F.coalesce(F.array_contains(r["colors"], p["category"]), F.lit(False)), "colour")
        .when((r["sparkling"] == F.lit(True)) & ~p["sparkling"], "not sparkling")
        .when((r["sparkling"] == F.lit(False)) & p["sparkling"], "sparkling")
        .when(r["sweet_ok"].isNotNull() & p["sweetness"].isNotNull() & ~F.array_contains(r["sweet_ok"], p["sweetness"]), "sweetness")
        .when(some(r["grapes_avoid"]) & F.coalesce(F.arrays_overlap(r["grapes_avoid"], p["grapes"]), F.lit(False)), "grape")
        .when(F.coalesce(r["avoid_oak"], F.lit(False)) & F.coalesce(p["oak"], F.lit(False)), "oak")
    )


def hard_filter(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``(r, p, reason)``."""
    return pairs(requests, products).withColumn("reason", drop_reason(F.col("r"), F.col("p")))


def half_up(x: Column, digits: int) -> Column:
    """Rounded after nine digits, so that halves go up whatever the order of a sum."""
    return F.round(x.cast("decimal(18,9)"), digits).cast("double")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _has(tags: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(False))


def prepared(requests: DataFrame) -> DataFrame:
    """``requests`` and what the rules need of a request alone, worked out once for each and not for each pair."""
    r = {c: F.col(c) for c in requests.columns}
    a, tags = r["axes"], F.coalesce(r["tags"], F.array().cast("array<string>"))
    complement, other = aroma_links(tags)
    return requests.withColumns({
        "dish": a.isNotNull(),
        "slack": F.when(_has(tags, "десерт", "фрукты", "шоколад"), 0.0).otherwise(0.6),
        "contrast": F.coalesce(_has(tags, "сыр с плесенью", "печень") | (a["heat"] >= 2.5), F.lit(False)),
        "apart": ~F.coalesce(r["course"].isin("аперитив", "десерт"), F.lit(False)),
        "hot": F.greatest(a["heat"] / 4, F.greatest(F.lit(0.0), a["salt"] - 1.5) / 2.5),
        "binds": (a["fat"] >= 2.5) | (_has(tags, "красное мясо", "сыр") & (a["fat"] >= 2)),
        "complement": complement,
        "other": other,
        "foods": dish_food_tags(tags),
        "applicable": applicable_weight(r),
    })


def rules(r: Column, p: Column, red_tannin: Column, classic: Column) -> list[tuple[str, Column]]:
    """The rules' values, -1 to 1, null where a rule says nothing about the pair; ``r`` is of ``prepared`` requests, ``p`` of products ``with_common``."""
    a, dish = r["axes"], r["dish"]
    body, acid, sugar, known = p["body"], p["acidity"], p["sweetness"], p["tannin"]
    out: list[tuple[str, Column]] = [("weight", F.when(dish & body.isNotNull(), 1 - 2 * F.abs(a["intensity"] - body) / 3))]
    out.append(("fat_acid", F.when((a["fat"] >= 2) & acid.isNotNull(), a["fat"] / 4 * (acid - 2) / 1.5)))
    ds, slack = F.least(F.lit(3.0), a["sweet"]), r["slack"]
    sweet = (
        F.when(sugar.isNull(), F.when(ds >= 1, -0.3))
        .when(ds - sugar > slack, -F.least(F.lit(1.0), (ds - sugar - slack) / 1.5))
        .when(ds >= 1, F.when(sugar - ds <= 1, 0.5).otherwise(0.2))
        .when(r["contrast"] & sugar.isin(1, 2), 0.6)
        .when((sugar >= 2) & (ds < 1) & r["apart"], -0.2 * sugar)
        .when((sugar <= 1) & (ds < 1), F.when(sugar == 0, 0.4).otherwise(0.2))
    )
    out.append(("sweet", F.when(dish, sweet)))
    t = F.coalesce(known, F.when(p["category"] == "Красное", red_tannin))
    bitter = F.when((t >= 2) & (r["hot"] > 0.2), -F.least(F.lit(1.0), (t - 1) / 2.5 * r["hot"] * 1.6)).otherwise(0.0)
    smooth = F.when((t >= 2) & r["binds"], 0.6 * F.least(F.lit(1.0), t / 3.5) * F.least(F.lit(1.0), a["fat"] / 3)).otherwise(0.0)
    value = (bitter + smooth) * F.when(known.isNull(), 0.5).otherwise(1.0)
    out.append(("tannin", F.when(dish & t.isNotNull() & (value != 0), value)))
    out.append(("region", F.when(dish & (r["region"] == p["region"]), 1.0)))
    overlap = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    out.append(("aroma", F.when(dish & overlap(r["complement"], p["aroma"]), 0.8)))
    out.append(("aroma", F.when(dish & overlap(r["other"], p["aroma"]), 0.6)))
    out.append(("aroma", F.when(dish & overlap(r["foods"], p["food"]), 1.0)))
    oc, fizz = r["occasion"], p["sparkling"]
    occasion = (
        F.when((oc == "celebration") & fizz, 0.7)
        .when((oc == "aperitif") & (fizz | ((p["category"] == "Белое") & (body < 2))), 0.7)
        .when((oc == "aperitif") & (body > 3), -0.5)
        .when((oc == "business") & (p["common"] >= classic), 0.5)
        .when(oc.isin("date", "gift") & fizz, 0.3)
    )
    out.append(("occasion", occasion))
    target = F.when(r["body_pref"] == "light", 1.2).otherwise(3.5)
    wishes = [
        F.when(overlap(r["grapes_like"], p["grapes"]), 0.8),
        F.when(F.array_contains(r["regions"], p["region"]), 0.4),
        F.when(known.isNotNull() & (r["tannin_pref"] == "high"), F.when(known >= 2.8, 0.5).otherwise(-0.3)).when(known.isNotNull() & (r["tannin_pref"] == "low"), F.when(known <= 1.5, 0.5).otherwise(-0.4)),
        F.when(r["body_pref"].isNotNull() & body.isNotNull(), 0.6 * (1 - F.abs(target - body) / 2.5)),
        F.when(r["sweet_ok"].isNotNull() & sugar.isNull(), -0.3),
    ]
    out.append(("prefs", F.when(F.coalesce(*wishes).isNotNull(), sum((F.coalesce(w, F.lit(0.0)) for w in wishes), F.lit(0.0)))))
    return [(name, F.when(v.isNotNull(), _clamp(v))) for name, v in out]


def applicable_weight(r: dict[str, Column] | Column) -> Column:
    """The weights of the rules that a request can call on."""
    a, w = r["axes"], RULES
    part = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), w[name]).otherwise(0.0)
    complement, other = aroma_links(F.coalesce(r["tags"], F.array().cast("array<string>")))
    wishes = (F.coalesce(F.size(r["grapes_like"]), F.lit(0)) > 0) | (F.coalesce(F.size(r["regions"]), F.lit(0)) > 0) | r["tannin_pref"].isNotNull() | r["body_pref"].isNotNull() | r["sweet_ok"].isNotNull()
    return (
        part(a.isNotNull(), "weight")
        + part(a.isNotNull(), "sweet")
        + part(a["fat"] >= 2, "fat_acid")
        + part((a["fat"] >= 2.5) | (a["heat"] >= 1.2) | (a["salt"] >= 2.5), "tannin")
        + part(r["region"].isNotNull(), "region")
        + part(F.size(F.concat(complement, other)) > 0, "aroma")
        + part(r["occasion"].isNotNull(), "occasion")
        + part(wishes, "prefs")
    )


def final_score(total: Column, applicable: Column) -> Column:
    """0 to 100: 50 and half the weighted share of the applicable weight, 3 at least."""
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 50 * total / F.greatest(applicable, F.lit(3.0)))), 1)


def unknown_features(r: Column, p: Column, red_tannin: Column) -> Column:
    """What rules ask of a product that does not say it, sorted; the tannin of a red one is estimated then."""
    dish, lacks = r["dish"], lambda name: p[name].isNull()
    asked = [("acidity", dish & (r["axes"]["fat"] >= 2) & lacks("acidity")), ("body", dish & lacks("body")), ("sweetness", dish & lacks("sweetness")), ("tannin", dish & lacks("tannin") & (p["category"] == "Красное") & red_tannin.isNotNull())]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in asked]))


def score(requests: DataFrame, products: DataFrame, keep_dropped: bool = False) -> DataFrame:
    """``(r, p, total, n_rules, contributions, unknown, score)`` of the pairs that pass the hard filter.

    The score is a sum of columns; ``contributions``, an array of ``(rule, value, weight)``, and ``unknown``, the features that rules ask
    for and the product does not state, are only built where they are asked for.
    """
    stats = F.broadcast(catalog_stats(products).select("red_tannin", "classic"))  # one row
    met = hard_filter(prepared(requests), with_common(products))
    met = (met if keep_dropped else met.where("reason is null")).crossJoin(stats)
    values = rules(F.col("r"), F.col("p"), F.col("red_tannin"), F.col("classic"))
    said = met.select("r", "p", unknown_features(F.col("r"), F.col("p"), F.col("red_tannin")).alias("unknown"), *[v.alias(f"v{i}") for i, (_, v) in enumerate(values)])
    total = sum((F.coalesce(F.col(f"v{i}") * RULES[name], F.lit(0.0)) for i, (name, _) in enumerate(values)), F.lit(0.0))
    count = sum((F.col(f"v{i}").isNotNull().cast("long") for i in range(len(values))), F.lit(0).cast("long"))
    each = [F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(name).alias("rule"), F.col(f"v{i}").alias("value"), F.lit(RULES[name]).alias("weight"))) for i, (name, _) in enumerate(values)]
    summed = said.select("r", "p", total.alias("total"), count.alias("n_rules"), F.array_compact(F.array(*each)).alias("contributions"), "unknown")
    return summed.withColumn("score", final_score(F.col("total"), F.col("r.applicable")))


def style_similarity(a: Column, b: Column) -> Column:
    same = lambda x, y, w: F.when(F.coalesce(x == y, F.lit(False)), w).otherwise(0.0)
    grape = F.when(F.coalesce(F.arrays_overlap(a["grapes"], b["grapes"]), F.lit(False)), 0.4).otherwise(0.0)
    kind = F.when(F.coalesce((a["category"] == b["category"]) & (a["sparkling"] == b["sparkling"]), F.lit(False)), 0.3).otherwise(0.0)
    return grape + kind + same(a["region"], b["region"], 0.15) + same(a["winery"], b["winery"], 0.15)


def recommend(scored: DataFrame, k: int = 3) -> DataFrame:
    """``(request_id, rank, product_id, score)``: the best, then ``k - 1`` times the best score less SPREAD times the largest likeness to those picked.

    One product a name, the first HEAD by score, none more than FLOOR below the best; ties by catalog order.
    """
    rows = scored.select(F.col("r.request_id").alias("request_id"), "p", "score")
    by_name = Window.partitionBy("request_id", "p.name").orderBy(F.desc("score"), "p.ord")
    by_score = Window.partitionBy("request_id").orderBy(F.desc("score"), "p.ord")
    single = rows.withColumn("n", F.row_number().over(by_name)).where("n = 1").withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= HEAD)
    left = single.withColumn("best", F.max("score").over(Window.partitionBy("request_id"))).where(F.col("score") >= F.col("best") - FLOOR).withColumn("near", F.lit(0.0))
    left = written(left, "recommend-head")  # at most HEAD rows a request
    picked = None
    for rank in range(1, k + 1):
        order = Window.partitionBy("request_id").orderBy(F.desc(F.col("score") - SPREAD * F.col("near")), "n")
        tried = left.withColumn("o", F.row_number().over(order))
        took = F.first(F.when(F.col("o") == 1, F.col("p")), True).over(Window.partitionBy("request_id"))
        tried = tried.withColumn("took", took)
        chosen = tried.where("o = 1").select("request_id", F.lit(rank).alias("rank"), F.col("p.product_id").alias("product_id"), "score", "p")
        picked = chosen if picked is None else picked.unionByName(chosen)
        left = tried.where("o > 1").withColumn("near", F.greatest("near", style_similarity(F.col("p"), F.col("took")))).drop("o", "took")
    return picked


def assign_role(rank: Column, common: Column, classic: Column) -> Column:
    """By how often the most frequent of a product's grapes is named in the catalog (``with_common``), and the count ``classic`` of ``catalog_stats``."""
    return F.when(rank == 1, "best match").when(common <= RARE, "rare").when(common >= classic, "classic").otherwise("other")


def with_share(scored: DataFrame) -> DataFrame:
    """``scored`` and ``share``, the share of the catalog that scores lower for the same request, and ``best``, the highest score.

    Scores have one digit: they are counted for each request, 1,001 values at most, and the counts are cumulated and joined back.
    """
    counts = scored.groupBy(F.col("r.request_id").alias("_request"), F.col("score").alias("_score")).agg(F.count("*").alias("n"))
    every = Window.partitionBy("_request")
    below = F.coalesce(F.sum("n").over(every.orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select("_request", "_score", half_up(below / F.sum("n").over(every), 2).alias("share"), F.max("_score").over(every).alias("best"))
    return scored.join(shares, (F.col("r.request_id") == F.col("_request")) & (F.col("score") == F.col("_score"))).drop("_request", "_score")


def dish_rank(scored: DataFrame) -> DataFrame:
    """The share of the catalog that scores lower for the same request, and the best score."""
    kept = written(scored.select(F.struct("r.request_id").alias("r"), F.struct("p.product_id").alias("p"), "score"), "dish-scores")  # the rules are read once, not for the counts and again
    return with_share(kept).select(F.col("r.request_id").alias("request_id"), F.col("p.product_id").alias("product_id"), "score", "share", "best")


def best_dishes(scored: DataFrame, k: int = 4, without: DataFrame | None = None) -> DataFrame:
    """The ``k`` typical dishes (requests) of highest score for each product, those of ``without(product_id, request_id)`` left out."""
    rows = scored.select(F.col("p.product_id").alias("product_id"), F.col("r.request_id").alias("request_id"), "score")
    if without is not None:
        rows = rows.join(without, ["product_id", "request_id"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("score"), "request_id"))).where(F.col("rank") <= k)


#: What makes products alike. Without a column ``type`` all products of one category and fizz are of one type.
TRAITS = ["category", "sparkling", "sweetness", "body", "tannin", "acidity", "oak", "region", "type", "grapes", "aroma"]
#: What each trait is worth.
WORTH = {"grapes": 0.35, "type": 0.15, "body": 0.15, "tannin": 0.1, "acidity": 0.05, "aroma": 0.2, "sweetness": 0.05, "region": 0.1, "oak": 0.05}


def _close(x: Column, y: Column) -> Column:
    """1 to 0 over a distance of two; null unless both are known."""
    return F.greatest(F.lit(0.0), 1 - F.abs(x - y) / 2)


def likeness(a: Column, b: Column) -> Column:
    """The worth of the traits that two products share: whole for equal ones and for any grape, by nearness for scales, by the share of all for aromas."""
    scale = lambda name: F.coalesce(WORTH[name] * _close(a[name], b[name]), F.lit(0.0))
    union = F.size(F.array_union(a["aroma"], b["aroma"]))
    aroma = F.when(union > 0, WORTH["aroma"] * F.size(F.array_intersect(a["aroma"], b["aroma"])) / union).otherwise(0.0)
    flag = lambda name, c: F.when(F.coalesce(c, F.lit(False)), WORTH[name]).otherwise(0.0)
    same = lambda name: flag(name, a[name] == b[name])
    return flag("grapes", F.arrays_overlap(a["grapes"], b["grapes"])) + same("type") + scale("body") + scale("tannin") + scale("acidity") + aroma + same("sweetness") + same("region") + flag("oak", a["oak"] & b["oak"])


def reach(a: Column, without: list[str]) -> Column:
    """The largest likeness of a product with one that shares nothing on the lists ``without``."""
    known = {**{t: a[t].isNotNull() for t in ("type", "body", "tannin", "acidity", "sweetness", "region")}, **{t: F.size(a[t]) > 0 for t in ("grapes", "aroma")}, "oak": F.coalesce(a["oak"], F.lit(False))}
    return sum((F.when(known[t], w).otherwise(0.0) for t, w in WORTH.items() if t not in without), F.lit(0.0))


def likeness_reasons(a: Column, b: Column) -> Column:
    """What speaks for an alternative, in the order of the terms: shared grapes, type, near scales, up to three shared aromas, region, oak."""
    shared = lambda name: F.sort_array(F.array_intersect(a[name], b[name]))
    named = lambda what, list_: F.when(F.size(list_) > 0, F.concat(F.lit(f"{what}: "), F.array_join(list_, ", ")))
    scales = [F.when(_close(a[name], b[name]) >= 0.75, name) for name in ("body", "tannin", "acidity")]
    same = lambda name: F.when(a[name] == b[name], F.concat(F.lit(f"{name}: "), a[name]))
    return F.array_compact(F.array(named("grapes", shared("grapes")), same("type"), *scales, named("aroma", F.slice(shared("aroma"), 1, 3)), same("region"), F.when(a["oak"] & b["oak"], "oak")))


def _with_traits(rows: DataFrame) -> DataFrame:
    kind = F.col("type") if "type" in rows.columns else F.lit("same")
    lists = {c: F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in ("grapes", "aroma")}
    return rows.withColumn("traits", F.struct(*[(kind if c == "type" else lists.get(c, F.col(c))).alias(c) for c in TRAITS]))


def _first(rows: DataFrame, by: list, n: int, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: Entries, for each one needed, in the nearest profiles that a class looks into: at first, where these do not settle it, and at last all.
LOOKS, CHUNK = (48, 768, 1 << 40), 2000


def _without_grapes(rest: str) -> Column:
    return F.struct(*[F.col(f"{rest}.{t}").alias(t) for t in TRAITS if t != "grapes"], F.array().cast("array<string>").alias("grapes"))


def near_profiles(profiles: DataFrame, need: int) -> DataFrame:
    """``(a, b, least)``: the profiles ``b`` nearest to each asking ``a`` of ``profiles(profile, rest, n, asks)`` that together have ``need`` entries.

    A profile is the traits without grapes, ``n`` its entries. No other profile is nearer than ``least``, which is -1 where all are there. Nearness is the
    likeness without grapes, aromas by the most that their numbers allow; profiles of one category and fizz are compared chunk by chunk.
    """
    number = lambda c: F.coalesce(F.col(f"rest.{c}").cast("double"), F.lit(float("nan"))).alias(c)
    scales, hashed = ["body", "tannin", "acidity", "sweetness"], ["type", "region"]
    marks = [F.when(F.col(f"rest.{c}").isNotNull(), F.xxhash64(f"rest.{c}")).alias(c) for c in hashed]
    flat = profiles.select(F.xxhash64("rest.category", "rest.sparkling").alias("g"), "profile", F.col("n").alias("entries"), "asks", *[number(c) for c in scales], *[F.coalesce(m, F.lit(0)).alias(c) for m, c in zip(marks, hashed, strict=True)], F.coalesce("rest.oak", F.lit(False)).alias("oak"), F.xxhash64("rest.aroma").alias("aroma"), F.size("rest.aroma").cast("double").alias("scents"))

    def look(part: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        x = {c: part.column(c).to_numpy(zero_copy_only=False) for c in part.column_names}

        def nearest(left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
            left, right = left[x["asks"][left]], right[x["entries"][right] > 0]
            for at in range(0, len(left), 128) if len(right) else ():
                i, j = left[at : at + 128][:, None], right[None, :]
                total = np.where(x["oak"][i] & x["oak"][j], WORTH["oak"], 0.0)
                for c in ("body", "tannin", "acidity"):
                    total += WORTH[c] * np.nan_to_num(np.maximum(0.0, 1 - np.abs(x[c][i] - x[c][j]) / 2))
                for c in hashed:
                    total += np.where((x[c][i] == x[c][j]) & (x[c][i] != 0), WORTH[c], 0.0)
                total += np.where(x["sweetness"][i] == x["sweetness"][j], WORTH["sweetness"], 0.0)
                low, high = np.minimum(x["scents"][i], x["scents"][j]), np.maximum(x["scents"][i], x["scents"][j])
                same = np.where(x["aroma"][i] == x["aroma"][j], 1.0, np.where(low == high, (low - 1) / (low + 1), low / np.maximum(high, 1)))
                total += np.where(low > 0, WORTH["aroma"] * same, 0.0)
                total[i == j] = -1.0  # stands below
                total[np.abs(x["sweetness"][i] - x["sweetness"][j]) > 1] = -1.0  # never an alternative; unknown ones always are
                order = np.argsort(-total, axis=1, kind="stable")
                total = np.take_along_axis(total, order, axis=1)
                n = x["entries"][right][order]
                keep = (np.cumsum(n, axis=1) - n < need) & (total >= 0)
                a, b = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(x["profile"][i[a, 0]]), pa.array(x["profile"][right[order[a, b]]]), pa.array(total[a, b]), pa.array(n[a, b])], names=["a", "b", "near", "n"])

        for s, e in bounds:
            left, right = sides(x["mine"][s:e])
            yield from nearest(s + left, s + right)
            if not x["mine"][s:e].all():
                yield from nearest(s + right, s + left)

    met = deal(flat, ["g"], "profile", CHUNK).mapInArrow(lambda rows: walk(rows, ["g"], look), "a long, b long, near double, n long")
    own = profiles.where("asks and n > 0").select(F.col("profile").alias("a"), F.col("profile").alias("b"), reach(_without_grapes("rest"), []).alias("near"), "n")
    order = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    kept = met.unionByName(own).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col("n") < need)
    return kept.withColumn("least", F.when(F.max("upto").over(Window.partitionBy("a")) >= need, F.min("near").over(Window.partitionBy("a"))).otherwise(-1.0)).select("a", "b", "least")


def alternatives(base: DataFrame, products: DataFrame, k: int = 5, per_winery: int = 2, reasons: bool = True) -> DataFrame:
    """``(base_id, rank, product_id, likeness, reasons)``: products like each of ``base``: same category and sparkling, sweetness at most one level apart, one a (name, winery), ``per_winery`` a winery.

    Products of equal traits are one class, of which only the first entries by name can be picked, so a trait that many share
    costs no pairs of products. For each profile (the traits without grapes) and grape asked for, the first entries of the nearest profiles (``near_profiles``)
    make a list, and one for no grape; a class takes the first of its grapes' lists and of that one. Few entries are looked into at first; classes whose last entry needed is not
    better than all others could be look into more, at last into all. No pairs of classes are made. Names are compared in lower
    case without outer blanks; null categories are like none; ties go by name and id; repeated rows are one. Without ``reasons`` that column is left out.
    """
    own = _with_traits(products).select("product_id", "name", "winery", "traits", F.lower(F.trim("name")).alias("key"))
    asked = _with_traits(base).select(F.col("product_id").alias("base_id"), F.lower(F.trim("name")).alias("base_key"), F.col("winery").alias("base_winery"), "traits")
    classes = own.select("traits").unionByName(asked.select("traits")).distinct()
    classes = written(classes.where("traits.category is not null and traits.sparkling is not null").select(F.monotonically_increasing_id().alias("class"), "traits"), "alike-classes")
    # Files of packed rows look small: joins with what grows with the catalog are dealt out, else they would be collected in the driver and met in a task or two. Traits are hashed, as sorting by them is slow.
    numbered = lambda rows: rows.join(classes.select("class", F.struct("traits").alias("t")).hint("shuffle_hash"), F.struct("traits").eqNullSafe(F.col("t"))).drop("t", "traits")
    order, tie, limit = [F.desc("likeness"), "name", "product_id"], ["name", "product_id"], 3 * k + 1

    def first(rows: DataFrame, by: list[str], *order) -> DataFrame:
        """Each (name, winery) once, of a winery one more than its limit, for the base's own, and ``limit`` in all. The first of several lists' first rows are those of all their rows."""
        return _first(_first(_first(rows, [*by, "key", "winery"], 1, *order), [*by, "winery"], per_winery + 1, *order), by, limit, *order)

    entries = written(first(numbered(own), ["class"], *tie), "alike-entries")
    starts = written(numbered(asked), "alike-bases")

    # Entries of a profile that share a grape with a class are equally like it, and so are all that share none: those are in the list of no grape, as if all were.
    rest = F.struct(*[F.col(f"traits.{t}").alias(t) for t in TRAITS if t != "grapes"])
    lists = F.concat(F.array(F.lit("")), F.transform("traits.grapes", lambda g: F.concat(F.lit("="), g)))
    bare = classes.select("class", lists.alias("lists"), rest.alias("rest"))
    kinds = written(bare.select("rest").distinct().select(F.monotonically_increasing_id().alias("profile"), "rest"), "alike-kinds")
    bare = written(bare.join(kinds.select("profile", F.struct("rest").alias("t")), F.struct("rest").eqNullSafe(F.col("t"))).select("class", "profile", "lists"), "alike-profiles")
    held = entries.join(bare.hint("merge"), "class")
    listed = written(first(held.select(F.col("profile").alias("b"), F.explode("lists").alias("on"), *entries.columns), ["b", "on"], *tie), "alike-listed")
    sizes = held.groupBy("profile").agg(F.count("*").alias("n"))
    open_ = written(bare.join(starts.select("class").distinct().hint("merge"), "class", "left_semi").select(F.col("class").alias("of"), F.col("profile").alias("a"), "lists"), "alike-open")
    found = None
    for looks in LOOKS:
        asks = open_.select(F.col("a").alias("profile")).distinct().withColumn("asks", F.lit(True))
        rows = kinds.join(sizes, "profile", "left").join(asks, "profile", "left").na.fill({"n": 0, "asks": False})
        near = near_profiles(rows, looks * limit).join(kinds.select(F.col("profile").alias("a"), F.col("rest").alias("x")), "a").join(kinds.select(F.col("profile").alias("b"), F.col("rest").alias("y")), "b")
        near = near.where("x.category = y.category and x.sparkling = y.sparkling").select("a", "b", "least", likeness(_without_grapes("x"), _without_grapes("y")).alias("f"))
        near = written(near, "alike-near")
        wanted = open_.select("of", "a", F.explode("lists").alias("on"))
        met = wanted.select("a", "on").distinct().join(near, "a").join(listed.hint("merge"), ["b", "on"])
        met = met.withColumn("likeness", F.round(F.col("f") + F.when(F.col("on") != "", WORTH["grapes"]).otherwise(0.0), 6)).drop("b", "f", "least")
        met = written(first(met.repartition("a", "on"), ["a", "on"], *order), "alike-lists")
        new = written(first(wanted.join(met.hint("merge"), ["a", "on"]).drop("a", "on").repartition("of"), ["of"], *order), "alike-looked")
        if looks == LOOKS[-1]:
            done = new
        else:
            ends = new.groupBy("of").agg(F.count("*").alias("n"), F.min("likeness").alias("last")).join(open_.select("of", "a").hint("merge"), "of").join(near.groupBy("a").agg(F.max("least").alias("least")), "a")
            sure = written(ends.where((F.col("least") < 0) | (F.col("n") >= limit) & (F.col("last") > F.col("least") + WORTH["grapes"] + 1e-6)).select("of"), "alike-sure")
            done = new.join(sure.hint("merge"), "of", "left_semi")
            open_ = written(open_.join(sure.hint("merge"), "of", "left_anti"), "alike-open")
        found = done if found is None else found.unionByName(done)
        if open_.isEmpty():
            break

    met = starts.join(found.withColumnRenamed("class", "other").hint("merge"), F.col("class") == F.col("of"))
    other = (F.col("base_id") != F.col("product_id")) & ~(F.col("base_key").eqNullSafe(F.col("key")) & F.col("base_winery").eqNullSafe(F.col("winery")))
    capped = _first(met.where(other).repartition("base_id"), ["base_id", "winery"], per_winery, *order)
    picked = capped.withColumn("rank", F.row_number().over(Window.partitionBy("base_id").orderBy(*order))).where(F.col("rank") <= k)
    if not reasons:
        return picked.select("base_id", "rank", "product_id", "likeness")
    a, b = classes.select("class", F.col("traits").alias("a")), classes.select(F.col("class").alias("other"), F.col("traits").alias("b"))
    return picked.join(a.hint("merge"), "class").join(b.hint("merge"), "other").select("base_id", "rank", "product_id", "likeness", likeness_reasons(F.col("a"), F.col("b")).alias("reasons"))


def type_fit(scored: DataFrame, least: int = 5) -> DataFrame:
    """For each request and type of product: the mean of its five best, the rule that speaks most against and for it, and a verdict by the gap."""
    kind = [F.col("r.request_id").alias("request_id"), F.col("p.category").alias("category"), F.col("p.sparkling").alias("sparkling"), F.col("p.sweetness").alias("sweetness")]
    keys = ["request_id", "category", "sparkling", "sweetness"]
    rows = scored.where("p.sweetness is not null").select(*kind, "score", "contributions", F.col("p.ord").alias("ord"))
    # Counted apart, so that each task keeps five rows of a type and no more are sorted; a type may be of null category.
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))).where(F.col("i") <= 5)
    top = first.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    means = top.groupBy(*keys).agg(half_up(F.avg("score"), 1).alias("mean"), F.max("n").alias("n"))
    each = top.select(*keys, F.explode("contributions").alias("c")).groupBy(*keys, "c.rule").agg(
        F.sum(F.when(F.col("c.value") < 0, F.col("c.value") * F.col("c.weight") / 5)).alias("against"), F.sum(F.when(F.col("c.value") >= 0, F.col("c.value") * F.col("c.weight") / 5)).alias("for")
    )
    ends = each.groupBy(*keys).agg(F.min(F.when(F.col("against").isNotNull(), F.struct("against", "rule"))).alias("worst"), F.max(F.when(F.col("for").isNotNull(), F.struct("for", "rule"))).alias("best"))
    gap = F.max("mean").over(Window.partitionBy("request_id")) - F.col("mean")
    bad = F.coalesce((F.col("worst.rule") == "sweet") & (F.round("worst.against", 2) < -1), F.lit(False))
    verdict = F.when(bad, "avoid").when(gap <= 6, "fits").when(gap <= 14, "with reservations").otherwise("avoid")
    return means.join(ends, keys, "left").select(*keys, "mean", "n", F.col("worst.rule").alias("worst"), F.col("best.rule").alias("best"), verdict.alias("verdict"))


def group_profile(products: DataFrame, group: str, names: str = "aroma", top: int = 4) -> DataFrame:
    """For each group: size, means of the known scales, and the most frequent ``names`` with share and lift over all products."""
    sizes = products.groupBy(group).agg(F.count("*").alias("n"), *[half_up(F.avg(x), 2).alias(x) for x in ("body", "acidity", "tannin")])
    each = products.select(group, F.explode(names).alias("name"))
    every = each.groupBy("name").agg(F.count("*").alias("c_all"))
    counts = each.groupBy(group, "name").agg(F.count("*").alias("c")).join(every, "name").join(sizes, group).crossJoin(F.broadcast(products.agg(F.count("*").alias("n_all"))))
    share = counts.withColumn("share", F.round(F.col("c") / F.col("n"), 4)).withColumn("lift", F.when(F.col("c") >= F.greatest(F.lit(3.0), 0.15 * F.col("n")), F.round((F.col("c") / F.col("n")) / (F.col("c_all") / F.col("n_all")), 4)))
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), "name"))).where(F.col("rank") <= top)
    return ranked.select(group, "n", "body", "acidity", "tannin", "rank", "name", "c", "share", "lift")


def _top_names(each: DataFrame, group: str, k: int, to: str, *order: Column) -> DataFrame:
    """``(group, to)``: the first ``k`` values of ``name`` of each group in this order, ties by name."""
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order, "name"))).where(F.col("rank") <= k)
    return ranked.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias(to))


def group_summary(products: DataFrame, group: str, aroma: str = "aroma", food: str = "food", description: str = "description") -> DataFrame:
    """One row for each group: size, means of the known scales with how many know them, shares of traits, its four most frequent aromas, the three of
    largest lift above 1.25 (named in three products and 15 % of the group at least), three regions, three foods, and the names of three longest descriptions.
    """
    share = lambda cond, to: half_up(F.count_if(cond) / F.count("*"), 2).alias(to)
    scales = [x for name in ("body", "acidity", "tannin") for x in (half_up(F.avg(name), 2).alias(name), F.count(name).alias(f"n_{name}"))]
    shares = [share(F.col("tannin").isNotNull(), "tannin_mention"), share(F.col("sweetness") >= 2, "sweet_share"), share(F.col("sweetness") == 0, "dry_share"), share(F.col("oak"), "oak_share"), share(F.col("sparkling"), "sparkling_share")]
    sizes = products.groupBy(group).agg(F.count("*").alias("n"), *scales, *shares)
    counted = lambda c: products.select(group, c.alias("name")).where("name is not null").groupBy(group, "name").agg(F.count("*").alias("c"))
    scents = counted(F.explode(aroma))
    every = scents.groupBy("name").agg(F.sum("c").alias("c_all"))
    total = products.agg(F.count("*").alias("n_all"))
    lifted = scents.join(every, "name").join(sizes.select(group, "n"), group).crossJoin(F.broadcast(total)).withColumn("lift", F.round(F.col("c") / F.col("n") / (F.col("c_all") / F.col("n_all")), 9))  # one row
    distinct = lifted.where((F.col("c") >= F.greatest(F.lit(3.0), 0.15 * F.col("n"))) & (F.col("lift") > 1.25))
    longest = products.select(group, F.col("name"), F.length(description).alias("size"), F.col("product_id"))
    longest = longest.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), "name", "product_id"))).where("rank <= 3")
    examples = longest.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("examples"))
    parts = [_top_names(scents, group, 4, "top_aroma", F.desc("c")), _top_names(distinct, group, 3, "distinct_aroma", F.desc("lift")), _top_names(counted(F.col("region")), group, 3, "regions", F.desc("c")), _top_names(counted(F.explode(food)), group, 3, "foods", F.desc("c")), examples]
    for part in parts:
        sizes = sizes.join(part, group, "left")
    return sizes


def compare_groups(products: DataFrame, group: str, a: str, b: str, names: str = "aroma", least: float = 0.10, top: int = 4) -> DataFrame:
    """The ``top`` names whose shares in two groups differ by ``least`` or more."""
    sizes = products.groupBy(group).agg(F.count("*").alias("n"))
    shares = products.select(group, F.explode(names).alias("name")).groupBy(group, "name").count().join(sizes, group).select(group, "name", (F.col("count") / F.col("n")).alias("share"))
    side = lambda value, to: shares.where(F.col(group) == value).select("name", F.col("share").alias(to))
    both = side(a, "share_a").join(side(b, "share_b"), "name", "full_outer").na.fill(0.0, ["share_a", "share_b"])
    return both.withColumn("difference", F.round(F.col("share_a") - F.col("share_b"), 4)).where(F.abs("difference") >= least).orderBy(F.desc(F.abs("difference")), "name").limit(top)


def side_by_side(products: DataFrame, group: str, a: str, b: str, small: int = 10) -> DataFrame:
    """``(trait, value_a, value_b, difference, n_a, n_b, small_sample)``: means of the known scales and shares of traits of two groups; a group of fewer than ``small`` products is flagged. A group without products has no values."""
    share = lambda cond: F.count_if(cond) / F.count("*")
    traits = {**{x: F.avg(x) for x in ("body", "acidity", "tannin")}, "dry": share(F.col("sweetness") == 0), "sweet": share(F.col("sweetness") >= 2), "oak": share(F.col("oak")), "sparkling": share(F.col("sparkling"))}
    rows = products.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count("*").alias("n"), *[half_up(v, 2).alias(t) for t, v in traits.items()])
    long = rows.select(group, "n", F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("value")) for t in traits])).alias("x"))
    of = lambda value, c: F.max(F.when(F.col(group) == value, F.col(c)))
    wide = long.groupBy("x.trait").agg(of(a, "x.value").alias("value_a"), of(b, "x.value").alias("value_b"), F.coalesce(of(a, "n"), F.lit(0)).alias("n_a"), F.coalesce(of(b, "n"), F.lit(0)).alias("n_b"))
    return wide.withColumns({"difference": F.round(F.col("value_a") - F.col("value_b"), 4), "small_sample": F.least("n_a", "n_b") < small})


def sweet_clash(contributions: Column) -> Column:
    """Whether sweetness speaks strongly against the pair."""
    return F.exists(contributions, lambda c: (c["rule"] == "sweet") & (c["value"] <= -0.6))


def verdict_by_share(share: Column, clash: Column) -> Column:
    """By the share of the catalog that scores lower; a strong clash of sweetness makes it poor."""
    return F.when(clash, "poor").when(share >= 0.9, "great").when(share >= 0.7, "good").when(share >= 0.4, "ok").otherwise("poor")


def pairing_verdict(share: Column, contributions: Column) -> Column:
    """``verdict_by_share`` of a pair with its contributions."""
    return verdict_by_share(share, sweet_clash(contributions))


def explain_pick(contributions: Column, pros: int = 3, cons: int = 2) -> tuple[Column, Column]:
    """The strongest contributions for and against, by value times weight; of equal ones the earlier. Each is turned once into its key, and keys are sorted natively."""
    size = lambda c: F.abs(c["value"] * c["weight"])
    key = lambda keep: lambda c, i: F.when(keep(c), F.struct(size(c).alias("size"), (-i).alias("i"), c["rule"].alias("rule")))
    pick = lambda keep, n: F.slice(F.filter(F.sort_array(F.transform(contributions, key(keep)), False), lambda c: c.isNotNull()), 1, n)["rule"]
    return pick(lambda c: c["value"] > 0.15, pros), pick(lambda c: c["value"] < -0.15, cons)


def explained(scored: DataFrame) -> DataFrame:
    """``(request_id, product_id, pros, cons, verdict)``, the strongest rules comma-joined.

    The rules are read once: what they say is written as two short texts a pair, and only these meet the shares of the catalog.
    """
    pros, cons = explain_pick(F.col("contributions"))
    said = scored.select(F.struct("r.request_id").alias("r"), F.struct("p.product_id").alias("p"), "score", F.array_join(pros, ",").alias("pros"), F.array_join(cons, ",").alias("cons"), sweet_clash(F.col("contributions")).alias("clash"))
    ranked = with_share(written(said, "explained"))
    return ranked.select(F.col("r.request_id").alias("request_id"), F.col("p.product_id").alias("product_id"), "pros", "cons", verdict_by_share(F.col("share"), F.col("clash")).alias("verdict"))
