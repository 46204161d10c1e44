"""Requests (a row for each nation) against products (the parts): filters, rules, rankings and profiles.

Category, scales, aromas and the wishes are derived from keys, sizes and names, so that every rule speaks somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmatch.functions.storage import spread, table
from labelmatch.operators import matching as M
from labelmatch.operators.requests import dish_traits

_STRINGS = "cast(array() as array<string>)"
_PRODUCT = f"""struct(p_partkey as product_id, p_partkey as ord, p_name as name,
  case when p_type in ('ECONOMY', 'LARGE') then 'Красное' when p_type in ('SMALL', 'PROMO') then 'Белое' else p_type end as category,
  concat('R', p_partkey % 6) as region, p_brand as winery, array(split(p_name, ' ')[0], split(p_name, ' ')[1]) as grapes,
  if(p_size % 9 = 0, null, p_size % 4) as sweetness, p_size % 5 = 0 as sparkling, if(p_size % 7 = 0, null, 1 + (p_size % 6) * 0.5D) as acidity,
  if(p_size % 3 = 0, null, 1 + (p_partkey % 6) * 0.5D) as tannin, if(p_partkey % 11 = 0, null, 0.5D + (p_partkey % 8) * 0.5D) as body, p_size > 30 as oak,
  array('минеральность', 'цитрус', 'мёд', 'тёмные ягоды')[cast(p_size % 4 as int)] as a, if(p_partkey % 6 = 0, array('рыба'), {_STRINGS}) as food)"""
_REQUEST = f"""struct(cast(n_nationkey as bigint) as request_id,
  if(n_nationkey % 6 = 5, null, struct(0.5D + (n_nationkey % 8) * 0.5D as intensity, cast(n_nationkey % 5 as double) as fat, cast(n_nationkey % 4 as double) as acid, (n_nationkey % 7) * 0.5D as sweet, cast(n_nationkey % 5 as double) as salt, (n_nationkey % 6) * 0.6D as heat)) as axes,
  array(array('красное мясо'), array('рыба'), array('десерт'), array('сыр'), {_STRINGS})[n_nationkey % 5] as tags, concat('R', n_nationkey % 8) as region, if(n_nationkey % 7 = 0, 'аперитив', null) as course,
  if(n_nationkey % 4 = 1, array('Красное', 'MEDIUM'), {_STRINGS}) as colors, case n_nationkey % 5 when 1 then true when 2 then false end as sparkling,
  if(n_nationkey % 6 = 2, array(0, 1), null) as sweet_ok, if(n_nationkey % 5 = 0, array('red', 'bolt'), {_STRINGS}) as grapes_like, if(n_nationkey % 5 = 3, array('blue'), {_STRINGS}) as grapes_avoid, n_nationkey % 6 = 4 as avoid_oak,
  case n_nationkey % 4 when 0 then 'low' when 2 then 'high' end as tannin_pref, case n_nationkey % 5 when 2 then 'light' when 4 then 'full' end as body_pref, if(n_nationkey % 3 = 0, array('R1', 'R2'), {_STRINGS}) as regions,
  case n_nationkey % 6 when 0 then 'celebration' when 1 then 'aperitif' when 2 then 'business' when 3 then 'gift' end as occasion, if(n_nationkey % 2 = 0, array(cast(n_nationkey as bigint), 7L), cast(array() as array<bigint>)) as excluded_ids)"""


def products(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part")).selectExpr(f"{_PRODUCT} as p").select("p.*").withColumn("aroma", F.array("a")).drop("a")


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr(f"{_REQUEST} as r").select("r.*")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return M.score(requests(spark, d), products(spark, d))


def catalog_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.catalog_stats(products(spark, d)).select("classic", "red_tannin", "n_grapes")


def hard_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    out = M.hard_filter(requests(spark, d), products(spark, d))
    return out.groupBy(F.col("r.request_id").alias("request_id"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def score_rules(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.col("r.request_id").alias("request_id"), F.col("p.product_id").alias("product_id"), "score", "n_rules", F.round("total", 6).alias("total"))


def unknown_features(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(F.col("r.request_id").alias("request_id"), F.col("p.product_id").alias("product_id"), F.array_join("unknown", ",").alias("unknown"))


def recommend_topk(spark: SparkSession, d: str) -> DataFrame:
    return M.recommend(scored(spark, d)).select("request_id", "rank", "product_id", "score")


def dish_rank(spark: SparkSession, d: str) -> DataFrame:
    return M.dish_rank(scored(spark, d))


def best_dishes(spark: SparkSession, d: str) -> DataFrame:
    own = products(spark, d).select("product_id", (F.col("product_id") % 25).alias("request_id"))
    return M.best_dishes(M.score(requests(spark, d), products(spark, d), keep_dropped=True), 4, own).select("product_id", "request_id", "rank", "score")


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d)
    return M.alternatives(rows, rows, reasons=False)


def alternative_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives with their reasons, where products are of types."""
    rows = products(spark, d).withColumn("type", F.concat(F.lit("T"), F.col("product_id") % 3))
    return M.alternatives(rows, rows, 4, 1).select("base_id", "rank", "product_id", "likeness", F.array_join("reasons", "; ").alias("reasons"))


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return M.side_by_side(products(spark, d), "winery", "Brand#2", "Brand#17")


def type_fit(spark: SparkSession, d: str) -> DataFrame:
    bare = requests(spark, d).withColumns({"colors": F.expr(_STRINGS), "sparkling": F.lit(None).cast("boolean"), "sweet_ok": F.lit(None).cast("array<int>"), "grapes_avoid": F.expr(_STRINGS), "avoid_oak": F.lit(False), "excluded_ids": F.expr("cast(array() as array<bigint>)"), "grapes_like": F.expr(_STRINGS)})
    return M.type_fit(M.score(bare, products(spark, d)))


def group_profile(spark: SparkSession, d: str) -> DataFrame:
    return M.group_profile(products(spark, d), "winery", "grapes")


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    lists = ["top_aroma", "distinct_aroma", "regions", "foods", "examples"]
    out = M.group_summary(products(spark, d).withColumn("aroma", F.concat("aroma", F.slice("grapes", 1, 1))), "winery", description="name")
    return out.select(*[F.array_join(c, ",").alias(c) if c in lists else c for c in out.columns])


def compare_groups(spark: SparkSession, d: str) -> DataFrame:
    return M.compare_groups(products(spark, d), "category", "Красное", "Белое", "grapes", 0.001, 8)


def explain_pick(spark: SparkSession, d: str) -> DataFrame:
    return M.explained(scored(spark, d))


def assign_role(spark: SparkSession, d: str) -> DataFrame:
    picks = M.recommend(scored(spark, d)).select("request_id", "rank", "product_id")
    known = M.with_common(products(spark, d)).select("product_id", "common").crossJoin(F.broadcast(M.catalog_stats(products(spark, d))))
    return picks.join(known, "product_id").select("request_id", "rank", "product_id", M.assign_role(F.col("rank"), F.col("common"), F.col("classic")).alias("role"))


def traits(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request_id", F.when(F.col("axes").isNotNull(), F.array_join(dish_traits(F.struct("axes")), ",")).alias("traits"))


_P = """p AS (SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'Красное' WHEN p_type IN ('SMALL', 'PROMO') THEN 'Белое' ELSE p_type END AS category, 'R' || (p_partkey % 6) AS region, p_brand AS winery,
    [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS grapes, CASE WHEN p_size % 9 <> 0 THEN p_size % 4 END AS sweetness, p_size % 5 = 0 AS sparkling, CASE WHEN p_size % 7 <> 0 THEN 1 + (p_size % 6) * 0.5::DOUBLE END AS acidity,
    CASE WHEN p_size % 3 <> 0 THEN 1 + (p_partkey % 6) * 0.5::DOUBLE END AS tannin, CASE WHEN p_partkey % 11 <> 0 THEN 0.5 + (p_partkey % 8) * 0.5::DOUBLE END AS body, p_size > 30 AS oak,
    ['минеральность', 'цитрус', 'мёд', 'тёмные ягоды'][p_size % 4 + 1] AS aroma, p_partkey % 6 = 0 AS fishy FROM part)"""
_R = """r AS (SELECT n_nationkey::BIGINT AS request_id, n_nationkey % 6 <> 5 AS dish, CASE WHEN n_nationkey % 6 <> 5 THEN 0.5 + (n_nationkey % 8) * 0.5::DOUBLE END AS intensity, CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey % 5)::DOUBLE END AS fat,
    CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey % 4)::DOUBLE END AS acid, CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey % 7) * 0.5::DOUBLE END AS sweet, CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey % 5)::DOUBLE END AS salt,
    CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey % 6) * 0.6::DOUBLE END AS heat, ['красное мясо', 'рыба', 'десерт', 'сыр', ''][n_nationkey % 5 + 1] AS tag, 'R' || (n_nationkey % 8) AS region, CASE WHEN n_nationkey % 7 = 0 THEN 'аперитив' END AS course,
    CASE WHEN n_nationkey % 4 = 1 THEN ['Красное', 'MEDIUM'] ELSE [] END AS colors, CASE n_nationkey % 5 WHEN 1 THEN true WHEN 2 THEN false END AS sparkling, n_nationkey % 6 = 2 AS sweetish, n_nationkey % 5 = 0 AS likes, n_nationkey % 5 = 3 AS avoids,
    n_nationkey % 6 = 4 AS avoid_oak, CASE n_nationkey % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'high' END AS tannin_pref, CASE n_nationkey % 5 WHEN 2 THEN 'light' WHEN 4 THEN 'full' END AS body_pref, n_nationkey % 3 = 0 AS wants_region,
    CASE n_nationkey % 6 WHEN 0 THEN 'celebration' WHEN 1 THEN 'aperitif' WHEN 2 THEN 'business' WHEN 3 THEN 'gift' END AS occasion, n_nationkey FROM nation)"""
_STATS = """g AS (SELECT unnest(grapes) AS grape FROM p), gc AS (SELECT grape, count(*) AS n FROM g WHERE grape <> '' GROUP BY grape), gs AS (SELECT list_sort(list(n)) AS l, map(list(grape), list(n)) AS m FROM gc),
  reds AS (SELECT list_sort(list(tannin)) AS l FROM p WHERE category = 'Красное' AND tannin IS NOT NULL),
  st AS (SELECT gs.l[floor(len(gs.l) * 0.85)::INT + 1] AS classic, reds.l[floor(len(reds.l) / 2)::INT + 1] AS red_tannin, m, len(gs.l) AS n_grapes FROM gs, reds)"""
_REASON = """CASE WHEN n_nationkey % 2 = 0 AND (p.product_id = n_nationkey OR p.product_id = 7) THEN 'excluded' WHEN len(colors) > 0 AND NOT list_contains(colors, category) THEN 'colour' WHEN r.sparkling AND NOT p.sparkling THEN 'not sparkling'
    WHEN NOT r.sparkling AND p.sparkling THEN 'sparkling' WHEN sweetish AND sweetness NOT IN (0, 1) THEN 'sweetness' WHEN avoids AND list_contains(grapes, 'blue') THEN 'grape' WHEN avoid_oak AND oak THEN 'oak' END"""
_COMPLEMENT = "CASE tag WHEN 'красное мясо' THEN aroma = 'тёмные ягоды' WHEN 'рыба' THEN aroma = 'минеральность' WHEN 'десерт' THEN aroma = 'мёд' ELSE false END"


def _rules_sql(where: str) -> str:
    """The rules written once more, on flat columns."""
    return f"""met AS (SELECT r.*, p.product_id, p.name, p.category, p.region AS p_region, p.winery, p.grapes, p.sweetness, p.sparkling AS fizz, p.acidity, p.tannin, p.body, p.oak, p.aroma, p.fishy, classic, red_tannin,
      list_max(list_transform(p.grapes, lambda g: m[g])) AS common, {_REASON} AS reason FROM r, p, st),
    kept AS (SELECT *, coalesce(tannin, CASE WHEN category = 'Красное' THEN red_tannin END) AS t, greatest(heat / 4, greatest(0.0, salt - 1.5) / 2.5) AS hot, least(3.0, sweet) AS ds, CASE WHEN tag = 'десерт' THEN 0.0 ELSE 0.6 END AS slack FROM met WHERE {where}),
    each AS (SELECT *, CASE WHEN dish THEN 1 - 2 * abs(intensity - body) / 3 END AS v1, CASE WHEN fat >= 2 THEN fat / 4 * (acidity - 2) / 1.5 END AS v2,
      CASE WHEN dish THEN CASE WHEN sweetness IS NULL THEN CASE WHEN ds >= 1 THEN -0.3 END WHEN ds - sweetness > slack THEN -least(1.0, (ds - sweetness - slack) / 1.5) WHEN ds >= 1 THEN CASE WHEN sweetness - ds <= 1 THEN 0.5 ELSE 0.2 END
        WHEN heat >= 2.5 AND sweetness IN (1, 2) THEN 0.6 WHEN sweetness >= 2 AND ds < 1 AND course IS NULL THEN -0.2 * sweetness WHEN sweetness <= 1 AND ds < 1 THEN CASE WHEN sweetness = 0 THEN 0.4 ELSE 0.2 END END END AS v3,
      CASE WHEN dish AND t IS NOT NULL THEN nullif((CASE WHEN t >= 2 AND hot > 0.2 THEN -least(1.0, (t - 1) / 2.5 * hot * 1.6) ELSE 0 END + CASE WHEN t >= 2 AND (fat >= 2.5 OR (tag IN ('красное мясо', 'сыр') AND fat >= 2)) THEN 0.6 * least(1.0, t / 3.5) * least(1.0, fat / 3) ELSE 0 END)
        * CASE WHEN tannin IS NULL THEN 0.5 ELSE 1 END, 0) END AS v4, CASE WHEN dish AND region = p_region THEN 1.0 END AS v5, CASE WHEN dish AND {_COMPLEMENT} THEN 0.8 END AS v6, CASE WHEN dish AND tag = 'рыба' AND aroma = 'цитрус' THEN 0.6 END AS v7,
      CASE WHEN dish AND tag = 'рыба' AND fishy THEN 1.0 END AS v8, CASE WHEN occasion = 'celebration' AND fizz THEN 0.7 WHEN occasion = 'aperitif' AND (fizz OR (category = 'Белое' AND body < 2)) THEN 0.7 WHEN occasion = 'aperitif' AND body > 3 THEN -0.5
        WHEN occasion = 'business' AND common >= classic THEN 0.5 WHEN occasion = 'gift' AND fizz THEN 0.3 END AS v9,
      CASE WHEN likes AND (list_contains(grapes, 'red') OR list_contains(grapes, 'bolt')) THEN 0.8 END AS w1, CASE WHEN wants_region AND p_region IN ('R1', 'R2') THEN 0.4 END AS w2, CASE WHEN tannin IS NOT NULL THEN CASE tannin_pref WHEN 'high' THEN CASE WHEN tannin >= 2.8 THEN 0.5 ELSE -0.3 END
        WHEN 'low' THEN CASE WHEN tannin <= 1.5 THEN 0.5 ELSE -0.4 END END END AS w3, CASE WHEN body_pref IS NOT NULL THEN 0.6 * (1 - abs(CASE body_pref WHEN 'light' THEN 1.2 ELSE 3.5 END - body) / 2.5) END AS w4, CASE WHEN sweetish AND sweetness IS NULL THEN -0.3 END AS w5 FROM kept),
    vals AS (SELECT *, CASE WHEN coalesce(w1, w2, w3, w4, w5) IS NOT NULL THEN coalesce(w1, 0) + coalesce(w2, 0) + coalesce(w3, 0) + coalesce(w4, 0) + coalesce(w5, 0) END AS v10 FROM each),
    lists AS (SELECT *, list_filter([{", ".join(f"{{'i': {i}, 'rule': '{n}', 'v': greatest(-1.0, least(1.0, v{i}))::DOUBLE, 'w': {w}::DOUBLE}}" for i, (n, w) in enumerate([("weight", 3), ("fat_acid", 2), ("sweet", 3.5), ("tannin", 2.5), ("region", 1), ("aroma", 1.5), ("aroma", 1.5), ("aroma", 1.5), ("occasion", 1.2), ("prefs", 2.5)], 1))}],
        lambda c: CASE c.i {" ".join(f"WHEN {i} THEN v{i} IS NOT NULL" for i in range(1, 11))} END) AS cs,
      CASE WHEN dish THEN 6.5 ELSE 0 END + CASE WHEN fat >= 2 THEN 2 ELSE 0 END + CASE WHEN fat >= 2.5 OR heat >= 1.2 OR salt >= 2.5 THEN 2.5 ELSE 0 END + 1 + CASE WHEN tag IN ('красное мясо', 'рыба', 'десерт') THEN 1.5 ELSE 0 END
        + CASE WHEN occasion IS NOT NULL THEN 1.2 ELSE 0 END + CASE WHEN likes OR wants_region OR tannin_pref IS NOT NULL OR body_pref IS NOT NULL OR sweetish THEN 2.5 ELSE 0 END AS applicable FROM vals),
    sc AS (SELECT *, coalesce(list_sum(list_transform(cs, lambda c: c.v * c.w)), 0.0)::DOUBLE AS total, round((greatest(0.0, least(100.0, 50 + 50 * coalesce(list_sum(list_transform(cs, lambda c: c.v * c.w)), 0.0) / greatest(applicable, 3.0))))::DOUBLE::DECIMAL(18, 9), 1)::DOUBLE AS score FROM lists)"""


_SCORED = f"WITH {_P}, {_R}, {_STATS}, {_rules_sql('reason IS NULL')}"
_BARE = _R.replace("CASE WHEN n_nationkey % 4 = 1 THEN ['Красное', 'MEDIUM'] ELSE [] END AS colors", "[]::VARCHAR[] AS colors").replace("CASE n_nationkey % 5 WHEN 1 THEN true WHEN 2 THEN false END AS sparkling", "NULL::BOOLEAN AS sparkling").replace("n_nationkey % 6 = 2 AS sweetish", "false AS sweetish").replace("n_nationkey % 5 = 0 AS likes", "false AS likes")
_LIKE = """CASE WHEN len(list_intersect(a.grapes, b.grapes)) > 0 THEN 0.35 ELSE 0 END + 0.15 + CASE WHEN a.body IS NOT NULL AND b.body IS NOT NULL THEN 0.15 * greatest(0.0, 1 - abs(a.body - b.body) / 2) ELSE 0 END
    + CASE WHEN a.tannin IS NOT NULL AND b.tannin IS NOT NULL THEN 0.1 * greatest(0.0, 1 - abs(a.tannin - b.tannin) / 2) ELSE 0 END + CASE WHEN a.acidity IS NOT NULL AND b.acidity IS NOT NULL THEN 0.05 * greatest(0.0, 1 - abs(a.acidity - b.acidity) / 2) ELSE 0 END
    + CASE WHEN a.aroma = b.aroma THEN 0.2 ELSE 0 END + CASE WHEN a.sweetness = b.sweetness THEN 0.05 ELSE 0 END + CASE WHEN a.region = b.region THEN 0.1 ELSE 0 END + CASE WHEN a.oak AND b.oak THEN 0.05 ELSE 0 END"""


def _strongest(keep: str, n: int) -> str:
    return f"array_to_string(list_transform(list_sort(list_transform(list_filter(cs, lambda c: {keep}), lambda c: {{'k': -abs(c.v * c.w), 'i': c.i, 'r': c.rule}}))[1:{n}], lambda c: c.r), ',')"


_NEAR = """CASE WHEN len(list_intersect(a.grapes, b.grapes)) > 0 THEN 0.4 ELSE 0.0 END + CASE WHEN a.category = b.category AND a.fizz = b.fizz THEN 0.3 ELSE 0.0 END + CASE WHEN a.p_region = b.p_region THEN 0.15 ELSE 0.0 END
    + CASE WHEN a.winery = b.winery THEN 0.15 ELSE 0.0 END"""


def _pick(rank: int, before: str, near: str) -> str:
    """The pick of this rank, and what is left with its likeness to the picks so far."""
    return f"""pick{rank} AS (SELECT * FROM {before} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score - {M.SPREAD} * {near} DESC, n) = 1),
  left{rank} AS (SELECT a.*, greatest(a.near{rank - 1}, ({_NEAR})::DOUBLE) AS near{rank} FROM {before} a JOIN pick{rank} b USING (request_id) WHERE a.n <> b.n)"""


_PICKS = f"""{_SCORED}, one AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY request_id, name ORDER BY score DESC, product_id) = 1),
  head AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS n, max(score) OVER (PARTITION BY request_id) AS best FROM one QUALIFY n <= {M.HEAD}),
  left0 AS (SELECT *, 0.0::DOUBLE AS near0 FROM head WHERE score >= best - {M.FLOOR}), {_pick(1, "left0", "near0")}, {_pick(2, "left1", "near1")}, {_pick(3, "left2", "near2")},
  picks AS (SELECT request_id, 1 AS rank, product_id, score, common, classic FROM pick1 UNION ALL SELECT request_id, 2, product_id, score, common, classic FROM pick2 UNION ALL SELECT request_id, 3, product_id, score, common, classic FROM pick3)"""

SQL = {
    "catalog_stats": f"WITH {_P}, {_STATS} SELECT classic, red_tannin, n_grapes FROM st",
    "hard_filter_reasons": f"WITH {_P}, {_R} SELECT request_id, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM r, p GROUP BY ALL",
    "score_rules": f"{_SCORED} SELECT request_id, product_id, score, len(cs) AS n_rules, round(total, 6) AS total FROM sc",
    "unknown_features": f"{_SCORED} SELECT request_id, product_id, concat_ws(',', CASE WHEN fat >= 2 AND acidity IS NULL THEN 'acidity' END, CASE WHEN dish AND body IS NULL THEN 'body' END, CASE WHEN dish AND sweetness IS NULL THEN 'sweetness' END, CASE WHEN dish AND tannin IS NULL AND t IS NOT NULL THEN 'tannin' END) AS unknown FROM sc",
    "dish_rank": f"{_SCORED} SELECT request_id, product_id, score, round(((rank() OVER (PARTITION BY request_id ORDER BY score) - 1) / count(*) OVER (PARTITION BY request_id))::DECIMAL(18, 9), 2)::DOUBLE AS share, max(score) OVER (PARTITION BY request_id) AS best FROM sc",
    "best_dishes": f"WITH {_P}, {_R}, {_STATS}, {_rules_sql('true')} SELECT product_id, request_id, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, request_id)::INT AS rank, score FROM sc WHERE request_id <> product_id % 25 QUALIFY rank <= 4",
    "alternatives": f"""WITH {_P}, met AS (SELECT a.product_id AS base_id, b.product_id, b.name, b.winery, round(({_LIKE})::DOUBLE, 6) AS likeness FROM p a JOIN p b ON a.category = b.category AND a.sparkling = b.sparkling
    WHERE (a.sweetness IS NULL OR b.sweetness IS NULL OR abs(a.sweetness - b.sweetness) <= 1) AND a.product_id <> b.product_id AND NOT (a.name = b.name AND a.winery = b.winery)),
  once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY base_id, name, winery ORDER BY likeness DESC, name, product_id) = 1), capped AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY base_id, winery ORDER BY likeness DESC, name, product_id) <= 2)
  SELECT base_id, row_number() OVER (PARTITION BY base_id ORDER BY likeness DESC, name, product_id)::INT AS rank, product_id, likeness FROM capped QUALIFY rank <= 5""",
    "alternative_reasons": f"""WITH {_P}, met AS (SELECT a.product_id AS base_id, b.product_id, b.name, b.winery, a, b, round(({_LIKE} - CASE WHEN a.product_id % 3 = b.product_id % 3 THEN 0 ELSE 0.15 END)::DOUBLE, 6) AS likeness FROM p a JOIN p b ON a.category = b.category AND a.sparkling = b.sparkling
    WHERE (a.sweetness IS NULL OR b.sweetness IS NULL OR abs(a.sweetness - b.sweetness) <= 1) AND a.product_id <> b.product_id AND NOT (a.name = b.name AND a.winery = b.winery)),
  once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY base_id, name, winery ORDER BY likeness DESC, name, product_id) = 1), capped AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY base_id, winery ORDER BY likeness DESC, name, product_id) <= 1),
  picked AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY likeness DESC, name, product_id)::INT AS rank FROM capped QUALIFY rank <= 4)
  SELECT base_id, rank, product_id, likeness, concat_ws('; ', CASE WHEN len(list_intersect(a.grapes, b.grapes)) > 0 THEN 'grapes: ' || array_to_string(list_sort(list_distinct(list_intersect(a.grapes, b.grapes))), ', ') END, CASE WHEN base_id % 3 = product_id % 3 THEN 'type: T' || (base_id % 3) END,
    {", ".join(f"CASE WHEN greatest(0.0, 1 - abs(a.{x} - b.{x}) / 2) >= 0.75 AND a.{x} IS NOT NULL AND b.{x} IS NOT NULL THEN '{x}' END" for x in ("body", "tannin", "acidity"))},
    CASE WHEN a.aroma = b.aroma THEN 'aroma: ' || a.aroma END, CASE WHEN a.region = b.region THEN 'region: ' || a.region END, CASE WHEN a.oak AND b.oak THEN 'oak' END) AS reasons FROM picked""",
    "side_by_side": f"""WITH {_P}, s AS (SELECT winery, count(*) AS n, {", ".join(f"round(({v})::DECIMAL(18, 9), 2)::DOUBLE AS {t}" for t, v in (("body", "avg(body)"), ("acidity", "avg(acidity)"), ("tannin", "avg(tannin)"), ("dry", "count(*) FILTER (sweetness = 0) / count(*)"), ("sweet", "count(*) FILTER (sweetness >= 2) / count(*)"), ("oak", "count(*) FILTER (oak) / count(*)"), ("sparkling", "count(*) FILTER (sparkling) / count(*)")))} FROM p WHERE winery IN ('Brand#2', 'Brand#17') GROUP BY winery),
  l AS (SELECT winery, n, unnest(['body', 'acidity', 'tannin', 'dry', 'sweet', 'oak', 'sparkling']) AS trait, unnest([body, acidity, tannin, dry, sweet, oak, sparkling]) AS v FROM s),
  w AS (SELECT trait, max(v) FILTER (winery = 'Brand#2') AS value_a, max(v) FILTER (winery = 'Brand#17') AS value_b, coalesce(max(n) FILTER (winery = 'Brand#2'), 0) AS n_a, coalesce(max(n) FILTER (winery = 'Brand#17'), 0) AS n_b FROM l GROUP BY trait)
  SELECT *, round(value_a - value_b, 4) AS difference, least(n_a, n_b) < 10 AS small_sample FROM w""",
    "type_fit": f"""WITH {_P}, {_BARE}, {_STATS}, {_rules_sql('true')}, rk AS (SELECT *, row_number() OVER (PARTITION BY request_id, category, fizz, sweetness ORDER BY score DESC, product_id) AS i, count(*) OVER (PARTITION BY request_id, category, fizz, sweetness) AS n FROM sc WHERE sweetness IS NOT NULL),
  tp AS (SELECT * FROM rk WHERE i <= 5 AND n >= 5), mn AS (SELECT request_id, category, fizz, sweetness, round(avg(score)::DECIMAL(18, 9), 1)::DOUBLE AS mean, max(n) AS n FROM tp GROUP BY ALL), cs1 AS (SELECT request_id, category, fizz, sweetness, unnest(cs) AS c FROM tp),
  ag AS (SELECT request_id, category, fizz, sweetness, c.rule AS rule, sum(c.v * c.w / 5) FILTER (c.v < 0) AS neg, sum(c.v * c.w / 5) FILTER (c.v >= 0) AS pos FROM cs1 GROUP BY ALL),
  en AS (SELECT request_id, category, fizz, sweetness, min((neg, rule)) FILTER (neg IS NOT NULL) AS worst, max((pos, rule)) FILTER (pos IS NOT NULL) AS best FROM ag GROUP BY ALL)
  SELECT request_id, category, fizz AS sparkling, sweetness, mean, n, worst[2] AS worst, best[2] AS best, CASE WHEN worst[2] = 'sweet' AND round(worst[1], 2) < -1 THEN 'avoid' WHEN max(mean) OVER (PARTITION BY request_id) - mean <= 6 THEN 'fits'
    WHEN max(mean) OVER (PARTITION BY request_id) - mean <= 14 THEN 'with reservations' ELSE 'avoid' END AS verdict FROM mn LEFT JOIN en USING (request_id, category, fizz, sweetness)""",
    "group_profile": f"""WITH {_P}, s AS (SELECT winery, count(*) AS n, round(avg(body)::DECIMAL(18, 9), 2)::DOUBLE AS body, round(avg(acidity)::DECIMAL(18, 9), 2)::DOUBLE AS acidity, round(avg(tannin)::DECIMAL(18, 9), 2)::DOUBLE AS tannin FROM p GROUP BY winery), x AS (SELECT winery, unnest(grapes) AS name FROM p), ca AS (SELECT name, count(*) AS c_all FROM x GROUP BY name),
  c AS (SELECT winery, name, count(*) AS c FROM x GROUP BY ALL), t AS (SELECT count(*) AS n_all FROM p)
  SELECT winery, n, body, acidity, tannin, row_number() OVER (PARTITION BY winery ORDER BY c DESC, name)::INT AS rank, name, c, round(c / n, 4) AS share, CASE WHEN c >= greatest(3.0, 0.15 * n) THEN round((c / n) / (c_all / n_all), 4) END AS lift FROM c JOIN ca USING (name) JOIN s USING (winery), t QUALIFY rank <= 4""",
    "group_summary": f"""WITH {_P}, q AS (SELECT *, [aroma, grapes[1]] AS scents FROM p), t AS (SELECT count(*) AS n_all FROM p), z AS (SELECT winery, count(*) AS n, {", ".join(f"round(avg({x})::DECIMAL(18, 9), 2)::DOUBLE AS {x}, count({x}) AS n_{x}" for x in ("body", "acidity", "tannin"))},
    {", ".join(f"round((count(*) FILTER ({c}) / count(*))::DECIMAL(18, 9), 2)::DOUBLE AS {to}" for c, to in (("tannin IS NOT NULL", "tannin_mention"), ("sweetness >= 2", "sweet_share"), ("sweetness = 0", "dry_share"), ("oak", "oak_share"), ("sparkling", "sparkling_share")))} FROM p GROUP BY winery),
  x AS (SELECT winery, unnest(scents) AS name FROM q), c AS (SELECT winery, name, count(*) AS c FROM x GROUP BY ALL), ca AS (SELECT name, sum(c) AS c_all FROM c GROUP BY name), l AS (SELECT winery, name, c, n, round(c / n / (c_all / n_all), 9) AS lift FROM c JOIN ca USING (name) JOIN z USING (winery), t),
  a1 AS (SELECT winery, string_agg(name, ',' ORDER BY rk) AS top_aroma FROM (SELECT *, row_number() OVER (PARTITION BY winery ORDER BY c DESC, name) AS rk FROM c QUALIFY rk <= 4) GROUP BY winery),
  a2 AS (SELECT winery, string_agg(name, ',' ORDER BY rk) AS distinct_aroma FROM (SELECT *, row_number() OVER (PARTITION BY winery ORDER BY lift DESC, name) AS rk FROM l WHERE c >= greatest(3.0, 0.15 * n) AND lift > 1.25 QUALIFY rk <= 3) GROUP BY winery),
  a3 AS (SELECT winery, string_agg(region, ',' ORDER BY rk) AS regions FROM (SELECT winery, region, row_number() OVER (PARTITION BY winery ORDER BY count(*) DESC, region) AS rk FROM p GROUP BY winery, region QUALIFY rk <= 3) GROUP BY winery),
  a4 AS (SELECT winery, CASE WHEN bool_or(fishy) THEN 'рыба' END AS foods FROM p GROUP BY winery),
  a5 AS (SELECT winery, string_agg(name, ',' ORDER BY rk) AS examples FROM (SELECT winery, name, row_number() OVER (PARTITION BY winery ORDER BY length(name) DESC, name, product_id) AS rk FROM p QUALIFY rk <= 3) GROUP BY winery)
  SELECT * FROM z LEFT JOIN a1 USING (winery) LEFT JOIN a2 USING (winery) LEFT JOIN a3 USING (winery) LEFT JOIN a4 USING (winery) LEFT JOIN a5 USING (winery)""",
    "compare_groups": f"""WITH {_P}, s AS (SELECT category, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT category, unnest(grapes) AS name FROM p), c AS (SELECT category, name, count(*) / any_value(n) AS share FROM x JOIN s USING (category) GROUP BY ALL),
  b AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.share, 0.0)::DOUBLE AS share_a, coalesce(b.share, 0.0)::DOUBLE AS share_b FROM (SELECT * FROM c WHERE category = 'Красное') a FULL JOIN (SELECT * FROM c WHERE category = 'Белое') b ON a.name = b.name)
  SELECT name, share_a, share_b, round(share_a - share_b, 4) AS difference FROM b WHERE abs(round(share_a - share_b, 4)) >= 0.001 ORDER BY abs(difference) DESC, name LIMIT 8""",
    "explain_pick": f"""{_SCORED}, b AS (SELECT *, round(((rank() OVER (PARTITION BY request_id ORDER BY score) - 1) / count(*) OVER (PARTITION BY request_id))::DECIMAL(18, 9), 2)::DOUBLE AS share FROM sc)
  SELECT request_id, product_id, {_strongest("c.v > 0.15", 3)} AS pros, {_strongest("c.v < -0.15", 2)} AS cons,
    CASE WHEN len(list_filter(cs, lambda c: c.rule = 'sweet' AND c.v <= -0.6)) > 0 THEN 'poor' WHEN share >= 0.9 THEN 'great' WHEN share >= 0.7 THEN 'good' WHEN share >= 0.4 THEN 'ok' ELSE 'poor' END AS verdict FROM b""",
    "recommend_topk": f"{_PICKS} SELECT request_id, rank, product_id, score FROM picks",
    "assign_role": f"{_PICKS} SELECT request_id, rank, product_id, CASE WHEN rank = 1 THEN 'best match' WHEN common <= {M.RARE} THEN 'rare' WHEN common >= classic THEN 'classic' ELSE 'other' END AS role FROM picks",
    "traits": f"""WITH {_R} SELECT request_id, CASE WHEN dish THEN concat_ws(',', CASE WHEN intensity <= 0.8 THEN 'very light' WHEN intensity <= 1.7 THEN 'light' WHEN intensity <= 2.5 THEN 'medium' WHEN intensity <= 3.3 THEN 'rich' ELSE 'very rich' END, CASE WHEN fat >= 2.5 THEN 'fat' END,
    CASE WHEN acid >= 2 THEN 'acid' END, CASE WHEN sweet >= 1.5 THEN 'sweet' END, CASE WHEN salt >= 3 THEN 'salty' END, CASE WHEN heat >= 2.5 THEN 'hot' WHEN heat >= 1.2 THEN 'peppery' END) END AS traits FROM r""",
}

QUERIES = {f.__name__: f for f in (catalog_stats, hard_filter_reasons, score_rules, unknown_features, recommend_topk, dish_rank, best_dishes, alternatives, alternative_reasons, type_fit, group_profile, group_summary, compare_groups, side_by_side, explain_pick, assign_role, traits)}
