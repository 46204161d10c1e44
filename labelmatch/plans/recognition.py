"""Recognition, twins and evaluation over ``embeddings`` and ``part``.

The first half of a vector is model A's, the second model B's. Queries are the rows whose id is
divisible by 20, against all other rows; a product is an id mod 100. A query's second view is the
mean with the next row. Similarities here are lower than between photos of one label, so the
thresholds are those of ZONES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmatch.functions.storage import table
from labelmatch.functions.vectors import l2_normalize
from labelmatch.operators import decide, evaluate, retrieve, twins

ZONES = {"found": 0.68, "gap": 0.10, "reject": 0.60}
K, POOL, VOTES, TWINS, AUDIT, LIMIT = 5, 30, 50, 0.4, 0.45, 2000


def refs(spark: SparkSession, d: str, half: str = "") -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null")
    vec = {"": F.col("embedding"), "A": F.slice("embedding", 1, 32), "B": F.slice("embedding", 33, 32)}[half]
    return e.select(F.col("vec_id").alias("vector_id"), (F.col("vec_id") % 100).alias("product_id"), vec.cast("array<double>").alias("vec"))


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.where("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), "vec")


def views(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, view, model, vec)``: two unit views for each model."""
    out = None
    for model in "AB":
        rows = refs(spark, d, model)
        one = queries_of(rows).withColumn("vec", l2_normalize(F.col("vec")))
        nxt = rows.select((F.col("vector_id") - 1).alias("query_id"), l2_normalize(F.col("vec")).alias("next"))
        two = one.join(nxt, "query_id", "left").select("query_id", l2_normalize(F.zip_with("vec", F.coalesce("next", "vec"), lambda x, y: (x + y) / 2)).alias("vec"))
        for view, part in ((1, one), (2, two)):
            part = part.select("query_id", F.lit(view).alias("view"), F.lit(model).alias("model"), "vec")
            out = part if out is None else out.unionByName(part)
    return out


def truth(spark: SparkSession, d: str) -> DataFrame:
    return queries_of(refs(spark, d)).select("query_id", (F.col("query_id") % 100).alias("expected"))


def nearest(spark: SparkSession, d: str, half: str = "", k: int = K) -> DataFrame:
    rows = refs(spark, d, half)
    return retrieve.nearest_products(queries_of(rows), rows, k)


def nearest_products(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d).select("query_id", "rank", "product_id", "vector_id", F.round("distance", 6).alias("distance"))


def average_views(spark: SparkSession, d: str) -> DataFrame:
    from labelmatch.functions.vectors import average_views as mean

    out = mean(views(spark, d).where("model = 'A'").select("query_id", "vec"), "query_id", "vec")
    return out.select("query_id", F.posexplode("vec")).select("query_id", F.col("pos").cast("long").alias("pos"), F.round("col", 6).alias("x"))


def votes_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = refs(spark, d)
    out = retrieve.nearest_with_votes_pool(queries_of(rows), rows, 10, VOTES)
    return out.select("query_id", "rank", "product_id", "votes", retrieve.vote_ratio("votes", VOTES).alias("vote_ratio"), F.round("distance", 6).alias("distance"))


def votes_scoped(spark: SparkSession, d: str) -> DataFrame:
    rows = refs(spark, d)
    scope = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("product_id"))
    out = retrieve.nearest_with_votes(queries_of(rows), rows, 10, VOTES, scope)
    return out.select("query_id", "rank", "product_id", "votes", F.round("distance", 6).alias("distance"))


def max_similarity(spark: SparkSession, d: str) -> DataFrame:
    pool = nearest(spark, d, "A", POOL)
    rows = refs(spark, d, "B")
    out = retrieve.max_similarity_by_product(queries_of(rows), rows, pool)
    return out.select("query_id", "product_id", F.round("similarity", 6).alias("similarity"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return decide.cascade(views(spark, d), refs(spark, d, "A"), refs(spark, d, "B"), K, POOL)


def fusion_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d)


def cascade_answers(spark: SparkSession, d: str) -> DataFrame:
    return decide.answers(ranked(spark, d), queries_of(refs(spark, d)), **ZONES)


def predict_top1(spark: SparkSession, d: str) -> DataFrame:
    return decide.predict_top1(cascade_answers(spark, d))


def twin_refs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("product_id"), F.col("vec_id").alias("vector_id"), F.col("embedding").cast("array<double>").alias("vec"))


def twin_products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"))


def twin_pairs(spark: SparkSession, d: str) -> DataFrame:
    return twins.twin_pairs(twin_refs(spark, d), TWINS, LIMIT).select("p1", "p2", F.round("similarity", 6).alias("similarity"))


def twin_clusters(spark: SparkSession, d: str) -> DataFrame:
    from labelmatch.functions.storage import written

    pairs = written(twins.linking_pairs(twin_refs(spark, d), TWINS), "twin-pairs")  # without LIMIT, which is the report's
    return twins.twin_clusters(pairs, twin_products(spark, d))


def twin_members(spark: SparkSession, d: str) -> DataFrame:
    return twins.twin_members(twins.linking_pairs(twin_refs(spark, d), TWINS), twin_products(spark, d))


def cells_visited(spark: SparkSession, d: str) -> DataFrame:
    rows = refs(spark, d)
    return retrieve.cells_visited(queries_of(rows), rows, K)


def cells_skipped(spark: SparkSession, d: str) -> DataFrame:
    return twins.cells_skipped(twin_refs(spark, d), TWINS)


def near_duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    out = twins.near_duplicate_audit(twin_refs(spark, d), twin_products(spark, d), AUDIT)
    return out.select("p1", "p2", "title1", "title2", "same_manufacturer", F.round("similarity", 6).alias("similarity"))


def approx_twin_pairs(spark: SparkSession, d: str) -> DataFrame:
    return twins.approx_twin_pairs(twin_refs(spark, d), TWINS).select("p1", "p2", F.round("similarity", 6).alias("similarity"))


def twin_recall(spark: SparkSession, d: str) -> DataFrame:
    return twins.twin_recall(twin_refs(spark, d), TWINS)


def hit_at_1(spark: SparkSession, d: str) -> DataFrame:
    first = nearest(spark, d, k=1).select("query_id", F.col("product_id").alias("predicted"), F.floor(F.col("distance") * 1000).alias("latency_ms"))
    return evaluate.hit_at_1(first, truth(spark, d))


def recall_at_pool(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at_pool(nearest(spark, d, "A", POOL), truth(spark, d))


def recognition_report(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("set"), F.col("label") % 3).alias("set"), F.when(F.col("label") >= 7, "out").otherwise("in").alias("kind"))
    first = nearest(spark, d, k=1).join(labels, "query_id").join(truth(spark, d), "query_id")
    status = decide.classify(1 - F.col("distance"), F.lit(None).cast("double"), 0.45, 0.1, 0.40)
    return evaluate.recognition_report(first.select("set", "kind", status.alias("status"), (F.col("product_id") == F.col("expected")).alias("correct"), F.floor(F.col("distance") * 1000).alias("latency_ms")))


def diff_runs(spark: SparkSession, d: str) -> DataFrame:
    def run(half: str) -> DataFrame:
        rows = nearest(spark, d, half, 1).join(truth(spark, d), "query_id")
        return rows.select("query_id", (F.col("product_id") % 10 == F.col("expected") % 10).alias("correct"))

    return evaluate.diff_runs(run("A"), run("B"))


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    """The cascade replayed: labels below 7 stand for photos of catalog products, the others for photos of none."""
    labels = table(spark, d, "embeddings").where("embedding is not null and vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 7, "in").otherwise("out").alias("kind"), F.array(F.col("vec_id") % 100).alias("accepted"))
    return evaluate.calibrate(evaluate.replay(views(spark, d), refs(spark, d, "A"), refs(spark, d, "B"), labels, **ZONES))


def confusable_pairs(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(spark, d, k=2).withColumn("product_id", F.col("product_id") % 5)
    return evaluate.confusable_pairs(near, truth(spark, d).withColumn("expected", F.col("expected") % 5))


def text_rerank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    near = nearest(spark, d, k=20).withColumn("similarity", F.round(1 - F.col("distance"), 6))
    named = near.join(docs.select(F.col("id").alias("query_id"), F.col("text").alias("query_text")), "query_id").join(docs.select(F.col("id").alias("product_id"), F.col("text").alias("description"), F.col("source").alias("title")), "product_id")
    out = decide.rerank_by_text(named, 10)
    return out.select("query_id", "product_id", "rank", "new_rank", F.round(F.col("text_score").cast("decimal(18,9)"), 6).cast("double").alias("text_score"))


def evidence_rerank(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(spark, d, k=10).withColumn("similarity", F.round(1 - F.col("distance"), 6))
    proof = near.withColumn("good", F.col("vector_id") % 400).withColumn("inliers", F.when(F.col("vector_id") % 7 != 0, F.floor(F.col("vector_id") % 400 / 2)))
    out = decide.rerank_by_match_evidence(proof, 0.35)
    return out.select("query_id", "product_id", "rank", "new_rank", F.round(F.col("evidence").cast("decimal(18,9)"), 6).cast("double").alias("evidence"))


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"


def _near(part: str, k: int, name: str = "near") -> str:
    v = {"": "v", "A": "v[1:32]", "B": "v[33:64]"}[part]
    return f"""{name}_d AS (SELECT q.vec_id AS query_id, r.vec_id % 100 AS product_id, r.vec_id AS vector_id, list_cosine_distance(q.{v}, r.{v}) AS dist
    FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
  {name}_b AS (SELECT * FROM {name}_d QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY dist, vector_id) = 1),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, product_id) AS rk FROM {name}_b QUALIFY rk <= {k})"""


_UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-9))"
_VIEWS = f"""halves AS (SELECT vec_id, 'A' AS model, {_UNIT.format(v="v[1:32]")} AS v FROM e UNION ALL SELECT vec_id, 'B', {_UNIT.format(v="v[33:64]")} FROM e),
  mixed AS (SELECT q.vec_id AS query_id, q.model, q.v AS one, list_transform(list_zip(q.v, coalesce(n.v, q.v)), lambda z: (z[1] + z[2]) / 2) AS two
    FROM halves q LEFT JOIN halves n ON n.vec_id = q.vec_id + 1 AND n.model = q.model WHERE q.vec_id % 20 = 0),
  views AS (SELECT query_id, model, 1 AS vw, one AS v FROM mixed UNION ALL SELECT query_id, model, 2, {_UNIT.format(v="two")} FROM mixed)"""
_MEAN = f"""means AS (SELECT a.query_id, list_transform(list_zip(a.v, b.v), lambda z: (z[1] + z[2]) / 2) AS m FROM views a JOIN views b USING (query_id, model) WHERE a.model = 'A' AND a.vw = 1 AND b.vw = 2),
  avgs AS (SELECT query_id, {_UNIT.format(v="m")} AS v FROM means)"""


def _cascade(left_out: str = "false", end: str = "") -> str:
    """The cascade over the views; products for which ``left_out`` holds are no candidates."""
    return f"""
  cand_d{end} AS (SELECT q.query_id, r.vec_id % 100 AS product_id, min(list_cosine_distance(q.v, r.v)) AS dist FROM avgs q JOIN halves r ON r.model = 'A' AND r.vec_id <> q.query_id AND NOT ({left_out}) GROUP BY ALL),
  cand{end} AS (SELECT * FROM cand_d{end} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, product_id) <= {POOL}),
  sims{end} AS (SELECT c.query_id, c.product_id, w.model, w.vw, 1 - min(list_cosine_distance(w.v, r.v)) AS s FROM cand{end} c JOIN views w USING (query_id)
    JOIN halves r ON r.model = w.model AND r.vec_id % 100 = c.product_id AND r.vec_id <> c.query_id GROUP BY ALL),
  raw{end} AS (SELECT c.query_id, c.product_id, coalesce(max(s) FILTER (model = 'B' AND vw = 1), -1) + coalesce(max(s) FILTER (model = 'B' AND vw = 2), -1)
      + 0.3 * (coalesce(max(s) FILTER (model = 'A' AND vw = 1), -1) + coalesce(max(s) FILTER (model = 'A' AND vw = 2), -1)) AS f,
      max(s) FILTER (model = 'A') AS a, max(s) FILTER (model = 'B') AS b FROM cand{end} c LEFT JOIN sims{end} USING (query_id, product_id) GROUP BY ALL),
  ranked{end} AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, product_id::VARCHAR)::INT AS rank, round(f, 4) AS fusion, round(a, 4) AS best_a, round(b, 4) AS best_b FROM raw{end}),
  answered{end} AS (SELECT *, round(fusion - lead(fusion) OVER (PARTITION BY query_id ORDER BY rank), 4) AS margin FROM ranked{end} QUALIFY rank = 1),
  judged{end} AS (SELECT *, CASE WHEN best_b < {ZONES["reject"]} THEN 'not_in_catalog' WHEN best_b >= {ZONES["found"]} AND coalesce(margin >= {ZONES["gap"]}, true) THEN 'found' ELSE 'probable' END AS status FROM answered{end})"""


_CASCADE = f"WITH {_E}, {_VIEWS}, {_MEAN}, {_cascade()}"
_TRUTH = "truth AS (SELECT vec_id AS query_id, vec_id % 100 AS expected FROM e WHERE vec_id % 20 = 0)"
_PAIRS = "pairs AS (SELECT a.vec_id AS p1, b.vec_id AS p2, 1 - list_cosine_distance(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)"
_TWINS = f"{_E}, {_PAIRS}, top AS (SELECT * FROM pairs WHERE s >= {TWINS})"

SQL = {
    "nearest_products": f"WITH {_E}, {_near('', K)} SELECT query_id, rk::INT AS rank, product_id, vector_id, round(dist, 6) AS distance FROM near",
    "average_views": f"WITH {_E}, {_VIEWS}, {_MEAN} SELECT query_id, unnest(range(len(v)))::BIGINT AS pos, round(unnest(v), 6) AS x FROM avgs",
    "votes_pool": f"""WITH {_E}, {_near("", K)}, pool AS (SELECT * FROM near_d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vector_id) <= {VOTES}),
  v AS (SELECT query_id, product_id, count(*) AS votes, min(dist) AS dist FROM pool GROUP BY ALL)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, product_id)::INT AS rank, product_id, votes, round(votes / {VOTES}, 4) AS vote_ratio, round(dist, 6) AS distance FROM v QUALIFY rank <= 10""",
    "votes_scoped": f"""WITH {_E}, {_near("", K)}, d AS (SELECT * FROM near_d WHERE product_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)),
  pool AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vector_id) <= {VOTES}), v AS (SELECT query_id, product_id, count(*) AS votes FROM pool GROUP BY ALL),
  b AS (SELECT query_id, product_id, min(dist) AS dist FROM d GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, product_id) AS rk FROM b QUALIFY rk <= 10)
  SELECT query_id, rk::INT AS rank, product_id, coalesce(votes, 1) AS votes, round(dist, 6) AS distance FROM t LEFT JOIN v USING (query_id, product_id)""",
    "max_similarity": f"""WITH {_E}, {_near("A", POOL)} SELECT n.query_id, n.product_id, round(1 - min(list_cosine_distance(q.v[33:64], r.v[33:64])), 6) AS similarity FROM near n JOIN e q ON q.vec_id = n.query_id
  JOIN e r ON r.vec_id % 100 = n.product_id AND r.vec_id <> n.query_id GROUP BY ALL""",
    "fusion_rank": f"{_CASCADE} SELECT * FROM ranked",
    "cascade_answers": f"""{_CASCADE} SELECT query_id, CASE WHEN status <> 'not_in_catalog' THEN product_id END AS winner, status, fusion, margin, best_b AS confidence,
  CASE status WHEN 'not_in_catalog' THEN 'similarity below reject' WHEN 'found' THEN 'similarity and margin' ELSE CASE WHEN best_b < {ZONES["found"]} THEN 'similarity below found' ELSE 'margin too small' END END AS reason FROM judged""",
    "predict_top1": f"{_CASCADE} SELECT query_id, CASE WHEN status = 'not_in_catalog' THEN status ELSE 'found' END AS status, CASE WHEN status <> 'not_in_catalog' THEN product_id END AS winner FROM judged",
    "twin_pairs": f"WITH {_TWINS} SELECT p1, p2, round(s, 6) AS similarity FROM top ORDER BY s DESC, p1, p2 LIMIT {LIMIT}",
    "twin_clusters": f"""WITH RECURSIVE {_TWINS}, edges AS (SELECT p1 AS u, p2 AS v FROM top UNION SELECT p2, p1 FROM top), reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
  comp AS (SELECT u AS node, least(u, min(v)) AS c FROM reach GROUP BY u), known AS (SELECT node, c, p_name AS title, p_brand AS m FROM comp JOIN part ON p_partkey = node),
  makers AS (SELECT c, m, count(*) AS n FROM known GROUP BY ALL), maker AS (SELECT c, m FROM makers QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, m) = 1), best AS (SELECT c, max(s) AS s FROM top JOIN comp ON node = p1 GROUP BY c)
  SELECT k.c AS cluster_id, count(*) AS size, round(least(1.0, greatest(0.0, any_value(best.s))), 4) AS max_similarity, any_value(maker.m) AS manufacturer, string_agg(node::VARCHAR, ',' ORDER BY title, node) AS members
  FROM known k JOIN best USING (c) JOIN maker USING (c) GROUP BY k.c HAVING count(*) >= 2""",
    "twin_members": f"""WITH RECURSIVE {_TWINS}, edges AS (SELECT p1 AS u, p2 AS v FROM top UNION SELECT p2, p1 FROM top), reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
  comp AS (SELECT u AS node, least(u, min(v)) AS c FROM reach GROUP BY u)
  SELECT c AS cluster_id, node AS product_id, p_name AS title, p_brand AS manufacturer FROM comp JOIN part ON p_partkey = node QUALIFY count(*) OVER (PARTITION BY c) >= 2""",
    "near_duplicate_audit": f"""WITH {_E}, {_PAIRS} SELECT p1, p2, a.p_name AS title1, b.p_name AS title2, a.p_brand IS NOT DISTINCT FROM b.p_brand AS same_manufacturer, round(s, 6) AS similarity
  FROM pairs JOIN part a ON a.p_partkey = p1 JOIN part b ON b.p_partkey = p2 WHERE s >= {AUDIT}""",
    "hit_at_1": f"""WITH {_E}, {_near("", 1)}, {_TRUTH}, l AS (SELECT *, floor(dist * 1000)::BIGINT AS ms FROM near) SELECT count(*) AS total, count(*) FILTER (product_id = expected) AS correct, round(avg(ms), 4) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms
  FROM l LEFT JOIN truth USING (query_id)""",
    "recall_at_pool": f"""WITH {_E}, {_near("A", POOL)}, {_TRUTH}, h AS (SELECT count(DISTINCT query_id) AS hits FROM near JOIN truth USING (query_id) WHERE product_id = expected), n AS (SELECT count(*) AS n FROM truth)
  SELECT n, hits, round(hits / greatest(n, 1), 4) AS recall FROM n, h""",
    "recognition_report": f"""WITH {_E}, {_near("", 1)}, {_TRUTH}, r AS (SELECT 'set' || (label % 3) AS s, CASE WHEN label >= 7 THEN 'out' ELSE 'in' END AS kind, product_id = expected AS ok,
    CASE WHEN 1 - dist < 0.40 THEN 'not_in_catalog' WHEN 1 - dist >= 0.45 THEN 'found' ELSE 'probable' END AS status, floor(dist * 1000)::BIGINT AS ms FROM near JOIN e ON vec_id = query_id JOIN truth USING (query_id))
  SELECT coalesce(s, 'ALL') AS set, median(ms)::DOUBLE AS median_ms, list_sort(list(ms))[greatest(0, floor(0.95 * count(*))::INT - 1) + 1] AS p95_ms, max(ms) AS max_ms, count(*) FILTER (kind = 'in') AS n_in, count(*) FILTER (kind = 'in' AND ok) AS top1, count(*) FILTER (kind = 'in' AND status = 'found') AS in_found, count(*) FILTER (kind = 'in' AND status = 'probable') AS in_probable,
    count(*) FILTER (kind = 'in' AND status = 'not_in_catalog') AS in_rejected, count(*) FILTER (kind = 'in' AND status = 'found' AND ok) AS found_correct, count(*) FILTER (kind = 'out' AND status = 'found') AS out_found,
    count(*) FILTER (kind = 'out' AND status = 'probable') AS out_probable, count(*) FILTER (kind = 'out' AND status = 'not_in_catalog') AS out_rejected FROM r GROUP BY ROLLUP (s)""",
    "diff_runs": f"""WITH {_E}, {_near("A", 1, "na")}, {_near("B", 1, "nb")}, a AS (SELECT query_id, product_id % 10 = query_id % 10 AS ok FROM na), b AS (SELECT query_id, product_id % 10 = query_id % 10 AS ok FROM nb)
  SELECT query_id, CASE WHEN NOT a.ok AND b.ok THEN 'fixed' WHEN a.ok AND NOT b.ok THEN 'broken' WHEN NOT a.ok AND NOT b.ok THEN 'still failing' ELSE 'same' END AS change FROM a JOIN b USING (query_id)""",
    "calibrate": f"""WITH {_E}, {_VIEWS}, {_MEAN}, {_cascade()}, {_cascade("r.vec_id % 100 = q.query_id % 100", "_x")}, l AS (SELECT vec_id AS query_id, label < 7 AS inside FROM e),
  t AS (SELECT CASE WHEN inside THEN 'positive' ELSE 'negative' END AS kind, best_b AS s, status FROM judged JOIN l USING (query_id) UNION ALL SELECT 'left_out', best_b, status FROM judged_x JOIN l USING (query_id) WHERE inside)
  SELECT {", ".join(f"count(*) FILTER (kind = '{k}' AND status = '{x}') AS {k}_{x}" for k in ("positive", "negative", "left_out") for x in ("found", "probable", "not_in_catalog"))},
    round(min(s) FILTER (kind = 'positive') - 0.02, 4) AS reject_at_most, round(max(s) FILTER (kind = 'negative') + 0.02, 4) AS found_at_least FROM t""",
    "confusable_pairs": f"""WITH {_E}, {_near("", 2)}, r AS (SELECT query_id, rk, product_id % 5 AS p, query_id % 5 AS x FROM near)
  SELECT a.x AS expected, a.p AS taken_for, count(*) AS n FROM r a JOIN r b ON a.query_id = b.query_id AND a.rk = 1 AND b.rk = 2 WHERE a.p <> a.x AND b.p = b.x GROUP BY ALL""",
    "text_rerank": rf"""WITH {_E}, {_near("", 20)}, w AS (SELECT n.query_id, n.product_id, rk, round(1 - dist, 6) AS sim, lower(coalesce(q.text, '')) AS a, lower(concat_ws(' ', p.text, p.source)) AS b FROM near n JOIN documents q ON q.doc_id = n.query_id JOIN documents p ON p.doc_id = n.product_id),
  t AS (SELECT *, list_distinct(regexp_extract_all(a, '[a-zа-яё0-9]{{2,}}')) AS x, list_distinct(regexp_extract_all(b, '[a-zа-яё0-9]{{2,}}')) AS y, regexp_extract(a, '\b(1[89]\d{{2}}|20[012]\d)\b', 1) AS ya, regexp_extract(b, '\b(1[89]\d{{2}}|20[012]\d)\b', 1) AS yb FROM w),
  s AS (SELECT *, 0.5 * sim + CASE WHEN ya <> '' AND ya = yb THEN 0.3 ELSE 0 END + CASE WHEN len(x) > 0 AND len(y) > 0 THEN 0.2 * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END AS score FROM t)
  SELECT query_id, product_id, rk::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rk > 10, CASE WHEN rk <= 10 THEN -score ELSE 0 END, rk)::INT AS new_rank, round(score::DECIMAL(18, 9), 6)::DOUBLE AS text_score FROM s""",
    "evidence_rerank": f"""WITH {_E}, {_near("", 10)}, s AS (SELECT query_id, product_id, rk, round(1 - dist, 6) AS sim, vector_id % 400 AS good, CASE WHEN vector_id % 7 <> 0 THEN floor((vector_id % 400) / 2) END AS inl FROM near),
  t AS (SELECT *, 0.4 * sim + coalesce(0.3 * least(1.0, inl / 300) + 0.3 * inl / greatest(1, good), 0) AS ev, max(sim) FILTER (rk = 1) OVER (PARTITION BY query_id) AS first FROM s)
  SELECT query_id, product_id, rk::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first >= 0.35 THEN -ev ELSE 0 END, rk)::INT AS new_rank, round(ev::DECIMAL(18, 9), 6)::DOUBLE AS evidence FROM t""",
}

QUERIES = {f.__name__: f for f in (nearest_products, average_views, votes_pool, votes_scoped, max_similarity, fusion_rank, cascade_answers, predict_top1, twin_pairs, twin_clusters, twin_members, cells_visited, cells_skipped, near_duplicate_audit, approx_twin_pairs, twin_recall, hit_at_1, recall_at_pool, recognition_report, diff_runs, calibrate, confusable_pairs, text_rerank, evidence_rerank)}
