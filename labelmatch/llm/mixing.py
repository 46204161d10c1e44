"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down the tree domain -> language -> source. At each node the children share
its tokens by weight; a child that cannot fill its share (tokens times epochs allowed) gives the
rest to its siblings, and only what all of them together cannot fill goes to the level above.
Each leaf then takes whole epochs of its documents and a prefix, in tokens, of one more epoch;
each epoch has a seeded order of its own.

No document is shuffled: a leaf's prefix is one threshold on the order key. It is found by sums
over buckets of the key, and among the rows of a single bucket, so a hot source costs no more
than its share of the partial sums. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.functions.storage import written

#: The query's tree: the domain is the number in the source's name mod 4; other weights are 1.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
SHARE, EPOCHS, SEED = 0.6, 2, "mix-1"
#: Leaves up to this number are broadcast; the count is checked.
MAX_BROADCAST = 100_000
#: Hex digits of the order key that make a bucket.
DIGITS = 4
LEAF = ["domain", "lang", "source"]


def n_tokens(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """``d`` and the number at the end of the name mod 4, which its last two digits tell; ``none`` without a number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,2})\z", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def weight_of(key: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    out = F.lit(float(default))
    for name, weight in weights.items():
        out = F.when(key == name, float(weight)).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], key: str, weight: str, capacity: str, amount: str, to: str) -> DataFrame:
    """Share ``amount`` among the children of each parent by weight, none above its capacity.

    Children in the order capacity / weight are full as long as their capacity does not exceed
    their part of what the earlier ones leave; the others share by the level reached there.
    """
    group = Window.partitionBy(*parent)
    before = group.orderBy(F.col(capacity) / F.col(weight), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(amount) - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))
    rest = F.sum(weight).over(group) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    level = nodes.where(F.col(weight) > 0).withColumn("_level", left / rest)
    return level.withColumn(to, F.greatest(F.lit(0.0), F.least(F.col(capacity), F.max("_level").over(group) * F.col(weight)))).drop("_level")


def allocate(leaves: DataFrame, share: float, epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, tokens, w_domain, w_lang, w_source)`` and the tokens each gets, ``alloc`` (long).

    The budget is ``share`` of all tokens; a leaf has room for ``epochs`` times its tokens. A child's weight is the largest in its leaves.
    """
    sized = leaves.withColumn("cap", F.col("tokens") * float(epochs))
    langs = sized.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w"), F.max("w_domain").alias("w_domain"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w"), F.sum("tokens").alias("tokens"))
    root = domains.withColumn("root", F.lit(0)).withColumn("amount", F.floor(F.sum("tokens").over(Window.partitionBy("root")) * F.lit(float(share))).cast("double"))
    first = fill(root, ["root"], "domain", "w", "cap", "amount", "amount_domain").select("domain", "amount_domain")
    second = fill(langs.join(first, "domain"), ["domain"], "lang", "w", "cap", "amount_domain", "amount_lang").select("domain", "lang", "amount_lang")
    third = fill(sized.join(second, ["domain", "lang"]), ["domain", "lang"], "source", "w_source", "cap", "amount_lang", "amount_leaf")
    return third.select(*LEAF, "tokens", F.floor(F.col("amount_leaf") + 1e-6).cast("long").alias("alloc"))


def order_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), doc_id.cast("string")))


def plan(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """For each leaf: ``domain, lang, source, tokens, alloc, full`` (whole epochs) and ``upto``, the last order key taken in the next epoch (or null)."""
    light = written(
        docs.select(F.col("doc_id"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n")),
        "mix-light",
    )
    sums = light.groupBy(*LEAF).agg(F.sum("n").alias("tokens"))
    weighted = sums.withColumns({
        "w_domain": weight_of(F.col("domain"), DOMAIN_WEIGHTS if domain_weights is None else domain_weights),
        "w_lang": weight_of(F.col("lang"), LANG_WEIGHTS if lang_weights is None else lang_weights),
        "w_source": weight_of(F.col("source"), source_weights or {}),
    })
    leaves = allocate(weighted, share, epochs).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int"))
    leaves = written(leaves.withColumn("rest", F.col("alloc") - F.col("full") * F.col("tokens")), "mix-leaves")
    keyed = light.join(_small(leaves), LEAF).withColumn("key", order_key(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, DIGITS))
    upward = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n").alias("n"), F.max("key").alias("last"))
    reached = buckets.withColumn("upto_n", F.sum("n").over(upward))
    whole = reached.where("upto_n <= rest").groupBy(*LEAF).agg(F.max("last").alias("whole"))
    cut = reached.where("upto_n > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("upto_n") - F.col("n")).alias("before"))).alias("cut")).select(*LEAF, "cut.*")
    inside = keyed.join(_small(cut), [*LEAF, "bucket"]).groupBy(*LEAF, "bucket", "rest", "before", "key").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*LEAF, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    part = inside.withColumn("sum", F.col("before") + F.sum("n").over(within)).where("sum <= rest").groupBy(*LEAF).agg(F.max("key").alias("part"))
    found = leaves.join(whole, LEAF, "left").join(part, LEAF, "left")
    upto = F.when(F.col("rest") > 0, F.coalesce(F.greatest("whole", "part"), "whole", "part"))
    return written(found.select(*LEAF, "tokens", "alloc", "full", upto.alias("upto")), "mix-plan")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its number of rows is within the bound."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def select(docs: DataFrame, leaves: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows ``(row struct of all columns of docs, domain, lang, source, epoch)``: each document once for each epoch that takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", domain_of(F.col("row.source")).alias("domain"), F.coalesce("row.lang", F.lit("")).alias("lang"), F.coalesce("row.source", F.lit("")).alias("source"))
    joined = rows.join(_small(leaves), LEAF)
    more = (F.col("upto").isNotNull() & (order_key(seed, F.col("full"), F.col("row.doc_id")) <= F.col("upto"))).cast("int")
    counted = joined.withColumn("copies", F.col("full") + F.coalesce(more, F.lit(0))).where("copies > 0")
    return counted.select("row", *LEAF, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, each row as often as epochs take it.

    Null languages and sources are leaves of their own, named ``''``; null and empty texts count no
    tokens and are taken with the prefix they fall in; rows with one doc_id share an order key
    and are taken together; no rows give no rows; further columns pass through; a text of any length counts
    whole. A leaf's sums are by 16 ** DIGITS buckets at most, so a window over a leaf holds no more rows than that.
    """
    chosen = select(docs, plan(docs, **options), options.get("seed", SEED))
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mixing(docs: DataFrame) -> DataFrame:
    chosen = select(docs.select("doc_id", "text", "lang", "source"), plan(docs))
    return chosen.select(F.col("row.doc_id").alias("doc_id"), *LEAF, n_tokens(F.col("row.text")).alias("n_tokens"), "epoch")


def _fill_sql(source: str, parent: str, key: str, weight: str, amount: str, to: str) -> str:
    window = f"(PARTITION BY {parent} ORDER BY cap / {weight}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    level = f"({amount} - coalesce(sum(cap) OVER {window}, 0.0)) / (sum({weight}) OVER (PARTITION BY {parent}) - coalesce(sum({weight}) OVER {window}, 0.0))"
    return f"SELECT *, greatest(0.0, least(cap, max(lvl) OVER (PARTITION BY {parent}) * {weight})) AS {to} FROM (SELECT *, {level} AS lvl FROM ({source}) s)"


def _case_sql(key: str, weights: dict[str, float]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END::DOUBLE"


def oracle_sql(documents: str = "documents") -> str:
    return rf"""
WITH light AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,2}})\z', 1) = '' THEN 'none'
      ELSE 'd' || (regexp_extract(source, '([0-9]{{1,2}})\z', 1)::INT % 4)::VARCHAR END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n
  FROM {documents}),
sized AS (SELECT domain, lang, source, sum(n)::DOUBLE AS tokens, sum(n)::DOUBLE * {EPOCHS} AS cap, {_case_sql("domain", DOMAIN_WEIGHTS)} AS w_domain,
    {_case_sql("lang", LANG_WEIGHTS)} AS w_lang, 1.0::DOUBLE AS w_source FROM light GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap) AS cap, max(w_lang) AS w, max(w_domain) AS w_domain, sum(tokens) AS tokens FROM sized GROUP BY ALL),
domains AS (SELECT 0 AS root, domain, sum(cap) AS cap, max(w_domain) AS w, sum(tokens) AS tokens FROM langs GROUP BY ALL),
roots AS (SELECT *, floor(sum(tokens) OVER () * {SHARE}::DOUBLE) AS amount FROM domains),
one AS ({_fill_sql("SELECT * FROM roots", "root", "domain", "w", "amount", "amount_domain")}),
two AS ({_fill_sql("SELECT l.*, amount_domain FROM langs l JOIN one USING (domain)", "domain", "lang", "w", "amount_domain", "amount_lang")}),
three AS ({_fill_sql("SELECT z.*, amount_lang FROM sized z JOIN two USING (domain, lang)", "domain, lang", "source", "w_source", "amount_lang", "amount_leaf")}),
leaves AS (SELECT domain, lang, source, tokens, floor(amount_leaf + 1e-6)::BIGINT AS alloc,
    CASE WHEN tokens > 0 THEN floor(floor(amount_leaf + 1e-6) / tokens) ELSE 0 END::INT AS full_n FROM three),
keyed AS (SELECT light.*, full_n, alloc - full_n * tokens::BIGINT AS rest, md5(concat_ws(':', '{SEED}', full_n::VARCHAR, doc_id::VARCHAR)) AS key
  FROM light JOIN leaves USING (domain, lang, source)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
counted AS (SELECT *, full_n + (rest > 0 AND upto <= rest)::INT AS copies FROM summed)
SELECT doc_id, domain, lang, source, n AS n_tokens, unnest(range(copies))::INT AS epoch FROM counted WHERE copies > 0
"""
