"""Features, sections and requests over ``documents`` and ``conversations``, with a small lexicon that their prose holds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmatch.functions.storage import spread, table
from labelmatch.functions.vectors import embed_in_batches
from labelmatch.operators import dishes as D
from labelmatch.operators import features as X
from labelmatch.operators import requests as R
from labelmatch.operators.lexicon import Lexicon

GROUPS = {"amber": "inghe|tionre", "birch": "schung|heit", "cedar": "queles|mente", "dune": "leoi|eaux", "ember": "thwh"}
FOODS = {"bread": "ering|ción", "fish": "ouch|ver", "salt": "shed|aron"}
LEX = Lexicon(
    sweetness=[("ingha|schver", 0), ("tione|heitch", 1), ("theon|ueci", 2), ("ande|eleau", 3)],
    sweetness_slug=[("src1", 0), ("src2", 1), ("src3", 2), ("src4", 3)],
    sweetness_phrases=["(the|der|de) [a-z]*(ande|theon)[a-z]*"],
    sparkling="whst|chch|quequ",
    tannin=("ering", "onha|reti", "andh|inin", "sthe|oren"),
    acidity=("ement", "onle|auxp", "tree|euxr", "éaiq|leoi"),
    acidity_diminutive="ción",
    body=[("thst|chpf", -0.8, 1.6), ("ndha|ungsch", -0.3, 0.6), ("onwh|eauê", 1.0, 1.6), ("reer|lich", 0.4, 0.8)],
    body_middle="ntha|oivi",
    oak="ouwh|ffff|pfch",
    months="([0-9]{1,2}) (the|of|de)",
    years="([0-9]{1,2}) (and|der|y)",
    ageing="ing",
    aroma=GROUPS,
    food=FOODS,
    pairing="with|mit|avec|con",
    serve="([0-9]{1,2})[-.]([0-9]{1,2})[-.]",
    alcohol=["ing ([0-9]{1,2}(?:[.,][0-9])?)", "([0-9]{1,2}(?:[.,][0-9])?) the"],
    grapes={"ennew": "X"},
)
SECTIONS = [("nose", "tion"), ("palate", "ering"), ("table", "ment"), ("finish", "ung")]
RULES = {"minor": "ingsh|chver", "driving": "onwh|eauel", "quantity": "[0-9]{3}", "decline": "heren|queen"}
MAIN = [("roast", "ering|schung", dict(intensity=3.5, fat=3, salt=1.5), ["meat"]), ("fish", "tion", dict(intensity=2, fat=1.5, salt=2), ["fish"]), ("raw fish", "shst|eleau", dict(intensity=1.7, fat=1, salt=1.5, acid=1), ["fish", "raw"]), ("cake", "andre|mente", dict(intensity=2.5, sweet=2.8), ["dessert"])]
MODIFIERS = [("hot", "whth|pfen", dict(heat=3), ["hot"], 0.4), ("sour", "onle|ciar", dict(acid=2.5), ["sour"], -0.2), ("steamed", "hath", dict(fat=0), [], -0.3)]
GENERAL = {"fish": (["raw fish"], "tioned")}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def _name():
    return F.substring(F.col("text"), 1, 60)


def feature_sweetness(spark: SparkSession, d: str) -> DataFrame:
    level, why = X.sweetness(_name(), F.col("source"), F.col("text"), LEX)
    return docs(spark, d).select("doc_id", level.alias("level"), why.alias("evidence"), X.sparkling(_name(), F.col("source"), F.col("text"), LEX).alias("sparkling"))


def feature_levels(spark: SparkSession, d: str) -> DataFrame:
    t = X.norm(F.col("text"))
    out = docs(spark, d).select("doc_id", X.window_level(t, *LEX.tannin).alias("w"), X.acidity(t, LEX).alias("a"))
    return out.select("doc_id", F.col("w.level").alias("tannin"), F.col("w.quote").alias("quote"), F.col("a.level").alias("acidity"))


def feature_body(spark: SparkSession, d: str) -> DataFrame:
    t = X.norm(F.col("text"))
    out = docs(spark, d).select("doc_id", t.alias("t"), X.window_level(t, *LEX.tannin)["level"].alias("tannin"), X.found(t, LEX.oak).alias("oak"), X.aging_months(t, LEX).alias("months"))
    return out.select("doc_id", "oak", "months", F.round(X.body(F.col("t"), F.col("tannin"), F.col("oak"), F.col("months"), LEX), 1).alias("body"))


def aroma_tags(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(X.tags(X.norm(F.col("text")), LEX.aroma), ",").alias("tags"))


def food_mentions(spark: SparkSession, d: str) -> DataFrame:
    out = docs(spark, d).select("doc_id", X.food_mentions(F.col("text"), LEX).alias("f"))
    return out.select("doc_id", F.array_join("f.tags", ",").alias("tags"), F.md5(F.coalesce("f.quote", F.lit(""))).alias("quote"))


def serve_and_alcohol(spark: SparkSession, d: str) -> DataFrame:
    t = X.norm(F.col("text"))
    out = docs(spark, d).select("doc_id", X.serve_temp(t, LEX).alias("s"), X.alcohol(t, LEX).alias("alcohol"))
    return out.select("doc_id", F.col("s.low").alias("low"), F.col("s.high").alias("high"), "alcohol")


def clean_grapes(spark: SparkSession, d: str) -> DataFrame:
    parts = F.concat_ws(", ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" (old)")))
    lex = Lexicon(grapes={"red": "Rouge", "small (old)": "Petit"}, not_grapes=["bolt"])
    return table(spark, d, "part").select("p_partkey", F.array_join(X.clean_grapes(parts, lex), "|").alias("grapes"))


def extract_features(spark: SparkSession, d: str) -> DataFrame:
    """All features in one projection."""
    catalog = docs(spark, d).select("doc_id", _name().alias("name"), F.col("source").alias("slug"), F.col("lang").alias("category"), F.lit("").alias("grape"), F.col("text").alias("description"))
    out = X.extract_features(catalog, LEX)
    return out.select("doc_id", "features.sweetness", "features.sparkling", "features.acidity", "features.tannin", "features.oak", "features.body", F.array_join("features.aroma", ",").alias("aroma"), F.array_join("features.food", ",").alias("food"), "type")


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = extract_features(spark, d)
    return X.coverage_report(rows, {c: F.when(F.col(c).isNotNull(), True) for c in ("sweetness", "acidity", "tannin", "body")} | {c: F.col(c) for c in ("sparkling", "oak")} | {"aroma": F.when(F.col("aroma") != "", True)})


def type_frequency(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select(F.when(F.col("p_size") % 10 != 3, F.concat_ws(" ", "p_type", F.col("p_size") % 7)).alias("type"))
    return X.frequencies(kinds, "type")


def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """A model that gives the numbers of letters and of words of whole texts, over chunks of rows."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = embed_in_batches(rows, lambda texts: [[len(t), t.count(" ") + 1] for t in texts], "text", 2)
    return out.select("doc_id", *[F.round(F.col("embedding")[i], 6).alias(f"x{i}") for i in (0, 1)])


def split_sections(spark: SparkSession, d: str) -> DataFrame:
    out = X.split_sections(docs(spark, d), "doc_id", "text", SECTIONS, "about")
    return out.select("doc_id", "section", F.length("text").cast("long").alias("n"), F.md5("text").alias("text"))


def scales_and_snippets(spark: SparkSession, d: str) -> DataFrame:
    level = (F.col("doc_id") % 7 / 2).cast("double")
    return docs(spark, d).select("doc_id", F.round(X.scale_profile(level, "body"), 4).alias("share"), X.band(level, 1.7, 2.8, ("light", "medium", "full")).alias("band"), X.snippet(F.regexp_replace("text", r"\s+", " "), 120).alias("snippet"))


def guardrail_code(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.guardrail_code(F.col("text"), RULES).alias("code"), F.array_join(X.tone_violations(F.col("text"), ["thoning", "schte", "aiel"]), ",").alias("tone"))


def parse_dish(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", R.parse_dish(F.col("text"), MAIN, MODIFIERS, GENERAL).alias("p"))
    return c.select("conv_id", "turn", *[F.col(f"p.axes.{a}").alias(a) for a in R.AXES], F.array_join("p.tags", ",").alias("tags"), F.array_join("p.mains", ",").alias("mains"))


def route_intent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("dish", F.coalesce(X.found(X.norm(F.col("text")), "ering|schung"), F.lit(False))).withColumn("n", X.found(X.norm(F.col("text")), "tion").cast("int") + X.found(X.norm(F.col("text")), "heit|ment").cast("int"))
    return c.select("conv_id", "turn", R.route_intent(F.col("text"), F.col("dish"), F.col("n"), "whon|eauon", "stre", "ouon|ungen", RULES).alias("intent"))


ASKED = ["Хочу красное сухое на день рождения, люблю танинные вина", "не люблю красное, лучше белое полусладкое до 1500 руб", "что-нибудь игристое на свидание, только не брют", "без пузырьков, шампанское не люблю; вино полегче", "посоветуйте донское плотное вино в подарок боссу", "впервые выбираю розовое, мягкие танины, без бочки", "мощное вино, терпкое, с послевкусием", "легкие закуски и вино"]


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Each whole message, followed by a request in Russian by the number of its words."""
    c = spread(table(spark, d, "conversations"))
    at = F.pmod(F.size(F.split("text", " ")), F.lit(len(ASKED)))
    return c.select("conv_id", "turn", F.concat("text", F.lit(". "), F.get(F.array(*map(F.lit, ASKED)), at)).alias("text"))


def parse_context(spark: SparkSession, d: str) -> DataFrame:
    out = asked(spark, d).select("conv_id", "turn", R.parse_context(F.col("text"), ["Россия", "Долина Дона"]).alias("c"))
    joined = [F.array_join(F.col(f"c.{s}").cast("array<string>"), ",").alias(s) for s in ("colors", "sweet_ok", "regions", "notes")]
    return out.select("conv_id", "turn", *joined, *[F.col(f"c.{s}").alias(s) for s in ("sparkling", "avoid_oak", "tannin_pref", "body_pref", "occasion", "experience")], F.col("c.dish").isNotNull().alias("has_dish"))


def grapes_in(spark: SparkSession, d: str) -> DataFrame:
    """Part names said with other endings, against two-word and one-word varieties made of the same words."""
    p = spread(table(spark, d, "part"))
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    vocabulary = p.select(F.explode(F.array(F.concat_ws(" ", one, two), one, two)).alias("grape")).where("p_partkey % 3 = 0 or p_size < 10")
    said = p.select("p_partkey", F.concat(F.lit("some "), one, F.lit("ish, "), F.when(F.col("p_partkey") % 2 == 0, two).otherwise(F.lit("none")), F.lit("s!")).alias("text"))
    return R.grapes_in(said, vocabulary, "p_partkey", "text")


def grape_wishes(spark: SparkSession, d: str) -> DataFrame:
    """What is liked and what is refused, from a message about two part names."""
    p = spread(table(spark, d, "part"))
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    said = p.select("p_partkey", F.concat(F.lit("Люблю "), one, F.lit(", но не люблю "), F.when(F.col("p_partkey") % 4 == 0, one).otherwise(two)).alias("text"))
    out = R.with_grapes(said.withColumn("context", R.parse_context(F.col("text"))), p.select(F.explode(F.array(one, two)).alias("grape")), "p_partkey", "text")
    return out.select("p_partkey", F.array_join("context.grapes_like", ",").alias("likes"), F.array_join("context.grapes_avoid", ",").alias("avoids"))


def merge_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Wishes of each conversation over its turns; what a turn states comes from which of a few words it holds."""
    t = X.norm(F.col("text"))
    pick = lambda *pairs: X.first_rule(t, list(pairs))
    tag = lambda p, v: F.when(X.found(t, p), F.lit(v))
    context = F.struct(
        R.parse_dish(F.col("text"), MAIN, MODIFIERS, GENERAL).alias("dish"),
        F.array_compact(F.array(tag("ering", "red"), tag("schung", "white"))).alias("colors"),
        F.array_compact(F.array(tag("tion", 0), tag("heit", 2))).alias("sweet_ok"),
        F.array_compact(F.array(tag("ment", "north"), tag("aux", "south"))).alias("regions"),
        F.when(X.found(t, "and"), X.found(t, "the")).alias("sparkling"),
        X.found(t, "ndth").alias("avoid_oak"),
        pick(("onwh", "low"), ("reth", "high")).alias("tannin_pref"),
        pick(("lyea", "light"), ("thst", "full")).alias("body_pref"),
        pick(("erou", "gift"), ("chver", "date")).alias("occasion"),
        pick(("[0-9]", "some")).alias("budget"),
        F.coalesce(pick(("ingti", "expert")), F.lit("novice")).alias("experience"),
    )
    out = R.merge_contexts(spread(table(spark, d, "conversations")).select("conv_id", "turn", context.alias("context")), "conv_id", "turn")
    c = F.col
    return out.select("conv_id", *[F.array_join(c(f"context.{s}").cast("array<string>"), ",").alias(s) for s in R.SETS], *[c(f"context.{s}").cast("string").alias(s) for s in R.SCALARS], F.array_join("context.dish.mains", ",").alias("mains"))


def _case(t: str, rules, end: str = "NULL", value=repr) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN {value(v)}" for p, v in rules) + f" ELSE {end} END"


_N = "replace(lower(coalesce({0}, '')), 'ё', 'е')"
_T = f"t AS (SELECT doc_id, source, lang, text, {_N.format('text')} AS t, {_N.format('substr(text, 1, 60)')} AS n FROM documents)"
_SLUG = "CASE source " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in LEX.sweetness_slug) + " END"
_HITN = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(n, '{p}') THEN regexp_extract(n, '({p})', 1) END" for p, _ in LEX.sweetness) + ")"


def _window(stem: str, low: str, mid: str, high: str, name: str) -> str:
    n = len(stem)
    return rf"""{name}_p AS (SELECT doc_id, t, string_split(t, '{stem}') AS p FROM t),
  {name}_s AS (SELECT doc_id, t, unnest(range(1, len(p))) AS i, p FROM {name}_p),
  {name}_o AS (SELECT doc_id, t, i, sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {n} AS s FROM {name}_s),
  {name}_g AS (SELECT doc_id, i, s, length(t) AS len, substring(t, greatest(s - 28, 0)::BIGINT + 1, (s + {n} + 28 - greatest(s - 28, 0))::BIGINT) AS g FROM {name}_o),
  {name}_e AS (SELECT doc_id, i, CASE WHEN s - 28 > 0 THEN regexp_replace(g, '^\S*\s', '') ELSE g END AS g, s, len FROM {name}_g),
  {name}_f AS (SELECT doc_id, i, CASE WHEN s + {n} + 28 < len THEN regexp_replace(g, '\s\S*(\n?)\z', '\1') ELSE g END AS g FROM {name}_e),
  {name}_l AS (SELECT doc_id, i, trim(g, ' ') AS g, CASE WHEN regexp_matches(g, '{high}') THEN 3.5 WHEN regexp_matches(g, '{low}') THEN 1.0 WHEN regexp_matches(g, '{mid}') THEN 2.0 END AS lv FROM {name}_f),
  {name} AS (SELECT doc_id, coalesce(lv, 2.0)::DOUBLE AS level, g AS quote FROM {name}_l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lv IS NULL, i) = 1)"""


_SENT = r"list_filter(string_split(regexp_replace(regexp_replace({0}, '([.!?{1}])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: true)"


def _tags(t: str, groups: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '{p}') THEN '{k}' END" for k, p in groups.items()) + "], lambda x: x IS NOT NULL))"


_MONTHS = f"CASE WHEN regexp_extract(t, '{LEX.months}', 1) <> '' THEN regexp_extract(t, '{LEX.months}', 1)::INT WHEN regexp_extract(t, '{LEX.years}', 1) <> '' AND regexp_matches(t, '{LEX.ageing}') THEN regexp_extract(t, '{LEX.years}', 1)::INT * 12 END"
_COUNT = "len(regexp_extract_all(t, '{0}'))"
_SCORE = "2.5" + "".join(f" + {'greatest' if x < 0 else 'least'}({-c if x < 0 else c}, {x} * {_COUNT.format(p)})" for p, x, c in LEX.body)
_SIGN = " OR ".join(f"regexp_matches(t, '{p}')" for p, _, _ in LEX.body)
_BODY = f"""CASE WHEN {_SIGN} OR regexp_matches(t, '{LEX.body_middle}') OR level IS NOT NULL OR (oak AND coalesce(months >= 6, false)) THEN
    greatest(0.5, least(4.0, round((CASE WHEN regexp_matches(t, '{LEX.body_middle}') THEN (({_SCORE}) + 2.5) / 2 ELSE {_SCORE} END
      + CASE WHEN level >= 3 THEN 0.6 WHEN level <= 1 THEN -0.2 WHEN level IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN oak AND coalesce(months >= 6, false) THEN 0.4 ELSE 0 END)::DOUBLE, 2))) END"""
_SWEET = f"""sw AS (SELECT doc_id, {_case("n", LEX.sweetness)} AS by_name, {_SLUG} AS by_slug, {_HITN} AS hit, CASE WHEN regexp_matches(t, '{LEX.sweetness_phrases[0]}') THEN regexp_extract(t, '({LEX.sweetness_phrases[0]})', 1) END AS ph FROM t),
  sx AS (SELECT *, {_case("ph", LEX.sweetness)} AS by_phrase FROM sw)"""
_ALL = f"""WITH {_T}, {_window(*LEX.tannin, name="tn")}, {_window(*LEX.acidity, name="ac")}, {_SWEET},
  base AS (SELECT t.*, tn.level, tn.quote, coalesce(ac.level, CASE WHEN regexp_matches(t.t, '{LEX.acidity_diminutive}') THEN 1.5 END)::DOUBLE AS acidity, regexp_matches(t.t, '{LEX.oak}') AS oak, {_MONTHS} AS months FROM t LEFT JOIN tn USING (doc_id) LEFT JOIN ac USING (doc_id)),
  food AS (SELECT doc_id, list_filter({_SENT.format("t", "")}, lambda s: regexp_matches(s, '{LEX.pairing}')) AS s FROM t),
  foods AS (SELECT doc_id, list_filter(s, lambda x: len({_tags("x", FOODS)}) > 0) AS s, list_sort(list_distinct(flatten(list_transform(s, lambda x: {_tags("x", FOODS)})))) AS f FROM food),
  every AS (SELECT b.doc_id, coalesce(by_name, by_slug, by_phrase)::INT AS sweetness, regexp_matches(concat_ws(' ', n, source, t), '{LEX.sparkling}') AS sparkling, acidity, level AS tannin, oak, {_BODY} AS body,
    array_to_string({_tags("t", GROUPS)}, ',') AS aroma, array_to_string(f, ',') AS food, lang FROM base b JOIN sx USING (doc_id) JOIN foods USING (doc_id))"""
_TYPE = "concat_ws(' ', lower(lang), CASE WHEN sparkling THEN 'игристое' END, CASE sweetness WHEN 0 THEN 'сухое' WHEN 1 THEN 'полусухое' WHEN 2 THEN 'полусладкое' WHEN 3 THEN 'сладкое' ELSE 'сладость не указана' END)"
_C = f"c AS (SELECT conv_id, turn, {_N.format('text')} AS t FROM conversations)"
_ON = {n: f"regexp_matches(t, '{p}')" for n, p, _, _ in MAIN}
_ON["fish"] = f"({_ON['fish']} AND (NOT {_ON['raw fish']} OR regexp_matches(t, 'tioned')))"
_MOD = {n: f"regexp_matches(t, '{p}')" for n, p, _, _, _ in MODIFIERS}
_PARTS = [(_ON[n], a, tg) for n, _, a, tg in MAIN] + [(_MOD[n], a, tg) for n, _, a, tg, _ in MODIFIERS]
_AXIS = lambda a: "greatest(0.0, " + ", ".join(f"CASE WHEN {c} THEN {float(x[a])} ELSE 0.0 END" for c, x, _ in _PARTS if a in x) + ")::DOUBLE"
_INT = "greatest(0.5, least(4.0, coalesce(greatest(" + ", ".join(f"CASE WHEN {_ON[n]} THEN {float(a['intensity'])} END" for n, _, a, _ in MAIN) + "), 2.5) + greatest(-0.5, least(0.9, " + " + ".join(f"CASE WHEN {_MOD[n]} THEN {x} ELSE 0.0 END" for n, _, _, _, x in MODIFIERS) + "))))::DOUBLE"


def _axis_sql(a: str) -> str:
    return _INT if a == "intensity" else _AXIS(a)


_DISH_TAGS = "array_to_string(list_sort(list_distinct(flatten(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {tg} END" for c, _, tg in _PARTS if tg) + ", CASE WHEN " + _AXIS("heat") + " >= 2.5 THEN ['острое'] END], lambda x: x IS NOT NULL)))), ',')"
_MAINS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _ON.items()) + "], lambda x: x IS NOT NULL)"

def _re2(p: str) -> str:
    """A Java pattern with Unicode classes in DuckDB's syntax; only whether it matches counts. What may not stand before is dealt with in the text."""
    p = p.replace("(?<!не )", "").replace("(?<!полу)", "").replace(r"(?<!\w)", r"\b")
    p = re.sub(r"\\b(?=\w)", r"(?:^|[^\\p{L}\\p{N}_])", p)
    return p.replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)").replace(r"\w", r"[\p{L}\p{N}_]")


def _listed(parts: list[tuple[str, str]], sort: bool) -> str:
    held = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in parts) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string({f'list_sort({held})' if sort else held}, ',')"


_STEMS = "w AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS p1, split_part(p_name, ' ', 2) AS p2 FROM part)"
_SAID = {"red": "ering", "white": "schung", "has_dry": "tion", "has_sweetish": "heit", "has_north": "ment", "has_south": "aux", "said_and": "and", "said_the": "the", "no_oak": "ndth"}
_SETS = {"colors": {"red": "red", "white": "white"}, "sweet_ok": {"has_dry": "0", "has_sweetish": "2"}, "regions": {"has_north": "north", "has_south": "south"}}
_PICKED = {"tannin_pref": [("onwh", "low"), ("reth", "high")], "body_pref": [("lyea", "light"), ("thst", "full")], "occasion": [("erou", "gift"), ("chver", "date")], "budget": [("[0-9]", "some")], "expertise": [("ingti", "expert")]}

SQL = {
    "feature_sweetness": f"""WITH {_T}, {_SWEET} SELECT doc_id, coalesce(by_name, by_slug, by_phrase)::INT AS level, CASE WHEN by_name IS NOT NULL THEN 'name: ' || hit WHEN by_slug IS NOT NULL THEN 'slug: ' || source
  WHEN by_phrase IS NOT NULL THEN 'description: ' || ph END AS evidence, regexp_matches(concat_ws(' ', n, source, t), '{LEX.sparkling}') AS sparkling FROM sx JOIN t USING (doc_id)""",
    "feature_levels": f"{_ALL} SELECT doc_id, level AS tannin, quote, acidity FROM base",
    "feature_body": f"{_ALL} SELECT doc_id, oak, months, round({_BODY}, 1) AS body FROM base",
    "aroma_tags": f"WITH {_T} SELECT doc_id, array_to_string({_tags('t', GROUPS)}, ',') AS tags FROM t",
    "food_mentions": f"{_ALL} SELECT doc_id, array_to_string(f, ',') AS tags, md5(coalesce(array_to_string(list_transform(s, lambda x: trim(x, ' ')), ' | '), '')) AS quote FROM foods",
    "serve_and_alcohol": f"""WITH {_T} SELECT doc_id, nullif(regexp_extract(t, '{LEX.serve}', 1), '')::INT AS low, CASE WHEN regexp_extract(t, '{LEX.serve}', 1) <> '' THEN regexp_extract(t, '{LEX.serve}', 2)::INT END AS high,
  coalesce(nullif(regexp_extract(t, '{LEX.alcohol[0]}', 1), ''), nullif(regexp_extract(t, '{LEX.alcohol[1]}', 1), '')).replace(',', '.')::DOUBLE AS alcohol FROM t""",
    "clean_grapes": """WITH p AS (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' (old)'] AS g FROM part),
  q AS (SELECT p_partkey, unnest(range(1, 4)) AS i, unnest(g) AS g FROM p), r AS (SELECT p_partkey, i, CASE lower(g) WHEN 'small (old)' THEN 'Petit' ELSE CASE regexp_replace(lower(g), '\\s*\\(.*?\\)', '') WHEN 'red' THEN 'Rouge' ELSE regexp_replace(g, '\\s*\\(.*?\\)', '') END END AS g FROM q WHERE trim(g) <> '' AND lower(g) <> 'bolt'),
  s AS (SELECT p_partkey, g, min(i) AS i FROM r GROUP BY ALL) SELECT p_partkey, coalesce(string_agg(g, '|' ORDER BY s.i), '') AS grapes FROM part LEFT JOIN s USING (p_partkey) GROUP BY p_partkey""",
    "extract_features": f"{_ALL} SELECT doc_id, sweetness, sparkling, acidity, tannin, oak, body, aroma, food, {_TYPE} AS type FROM every",
    "type_frequency": "SELECT CASE WHEN p_size % 10 <> 3 THEN p_type || ' ' || p_size % 7 END AS value, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, value NULLS LAST LIMIT 20",
    "embed_texts": "WITH c AS (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS a, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1)::DOUBLE AS b FROM documents) SELECT doc_id, round(a / sqrt(a * a + b * b), 6) AS x0, round(b / sqrt(a * a + b * b), 6) AS x1 FROM c",
    "coverage_report": f"""{_ALL}, n AS (SELECT count(*) AS n FROM every), c AS (SELECT 'sweetness' AS feature, count(sweetness) AS k FROM every UNION ALL SELECT 'acidity', count(acidity) FROM every UNION ALL SELECT 'tannin', count(tannin) FROM every
  UNION ALL SELECT 'body', count(body) FROM every UNION ALL SELECT 'sparkling', count(*) FILTER (sparkling) FROM every UNION ALL SELECT 'oak', count(*) FILTER (oak) FROM every UNION ALL SELECT 'aroma', count(*) FILTER (aroma <> '') FROM every)
  SELECT feature, k AS n, round(100.0 * k / greatest(n, 1), 1) AS percent FROM c, n""",
    "split_sections": rf"""WITH t AS (SELECT doc_id, {_SENT.format("coalesce(text, '')", ";")} AS s FROM documents), e AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS s FROM t), f AS (SELECT * FROM e WHERE trim(s, ' ') <> ''),
  h AS (SELECT *, list_sort(list_filter([{", ".join(f"CASE WHEN strpos(lower(s), '{w}') > 0 THEN (strpos(lower(s), '{w}'), '{n}') END" for n, w in SECTIONS)}], lambda x: x IS NOT NULL))[1][2] AS k FROM f),
  g AS (SELECT doc_id, pos, s, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'about') AS section FROM h),
  o AS (SELECT doc_id, section, string_agg(trim(s, ' '), ' ' ORDER BY pos) AS x FROM g GROUP BY ALL) SELECT doc_id, section, length(x) AS n, md5(x) AS text FROM o""",
    "scales_and_snippets": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t, (doc_id % 7) / 2.0 AS l FROM documents), h AS (SELECT *, substr(t, 1, 120) AS h, length(regexp_extract(substr(t, 1, 120), '(?s)^(.*[.!?])', 1)) AS e FROM t)
  SELECT doc_id, round(least(1.0, greatest(0.0, (l - 1) / 2))::DOUBLE, 4) AS share, CASE WHEN l < 1.7 THEN 'light' WHEN l < 2.8 THEN 'medium' ELSE 'full' END AS band,
    CASE WHEN length(t) <= 120 THEN t WHEN e > 60 THEN substr(h, 1, e) ELSE regexp_replace(h, '\s+\S*\z', '') || '…' END AS snippet FROM h""",
    "guardrail_code": f"WITH {_C} SELECT conv_id, turn, {_case('t', [(p, n) for n, p in RULES.items()])} AS code, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(t, '{p}') THEN '{p}' END''' for p in ('thoning', 'schte', 'aiel'))}], lambda x: x IS NOT NULL), ',') AS tone FROM c",
    "parse_dish": f"WITH {_C} SELECT conv_id, turn, {', '.join(f'CASE WHEN len({_MAINS}) > 0 THEN round({_axis_sql(a)}, 1) END AS {a}' for a in R.AXES)}, CASE WHEN len({_MAINS}) > 0 THEN {_DISH_TAGS} END AS tags, CASE WHEN len({_MAINS}) > 0 THEN array_to_string({_MAINS}, ',') END AS mains FROM c",
    "parse_context": f"""WITH a AS (SELECT conv_id, turn, {_N.format(f"(text || '. ' || {ASKED!r}[len(string_split(text, ' ')) % {len(ASKED)} + 1])")} AS t0, replace(t0, 'не сух', 'не_сух') AS t FROM conversations)
  SELECT conv_id, turn, {_listed([(f"regexp_matches(t, '{_re2(p)}') AND NOT list_contains(regexp_extract_all(t, 'не (?:люблю|хочу|надо|нужно) (красн|бел|розов|оранжев)', 1), '{stem}')", f"'{n}'") for n, p, stem in D.COLORS], sort=False)} AS colors,
    nullif(array_to_string(list_sort(list_distinct(flatten([{", ".join(f"CASE WHEN regexp_matches(t, '{_re2(p)}') THEN {list(levels)} ELSE [] END" for levels, p in D.SWEET_WISHES)}]))), ','), '') AS sweet_ok,
    {_listed([("contains(t, 'росси')", "'Россия'"), ("contains(t, 'долин') OR regexp_matches(t, 'донск|долина дона')", "'Долина Дона'")], sort=False)} AS regions, CASE WHEN regexp_matches(t, '{_re2(D.BUDGET)}') THEN '{D.BUDGET_NOTE}' ELSE '' END AS notes,
    CASE WHEN regexp_matches(t, '{_re2(D.FIZZ)}') THEN NOT regexp_matches(t, '{_re2(D.NO_FIZZ)}') END AS sparkling, regexp_matches(t, '{_re2(D.NO_OAK)}') AS avoid_oak, {_case("t", [(_re2(p), n) for n, p in D.TANNIN_WISHES])} AS tannin_pref,
    CASE WHEN regexp_matches(t, '{_re2(D.LIGHT)}') AND NOT regexp_matches(t, '{_re2(D.LIGHT_FOOD)}') THEN 'light' WHEN regexp_matches(t, '{_re2(D.FULL)}') THEN 'full' END AS body_pref, {_case("t", [(_re2(p), n) for n, p in D.OCCASIONS])} AS occasion,
    coalesce({_case("t", [(_re2(p), n) for n, p in D.EXPERIENCE])}, 'novice') AS experience, {" OR ".join(f"regexp_matches(t, '{_re2(p)}')" for _, p, _, _ in D.MAIN)} AS has_dish FROM a""",
    "grapes_in": f"""WITH {_STEMS}, v AS (SELECT DISTINCT grape, list_transform(string_split(lower(grape), ' '), lambda x: left(x, greatest(4, length(x) - 2))) AS st FROM (SELECT unnest([p1 || ' ' || p2, p1, p2]) AS grape FROM w WHERE p_partkey % 3 = 0 OR p_size < 10)),
  s AS (SELECT p_partkey, ' some ' || p1 || 'ish ' || CASE WHEN p_partkey % 2 = 0 THEN p2 ELSE 'none' END || 's ' AS t FROM w), m AS (SELECT p_partkey, grape, st[1] AS f, len(st) > 1 AND list_bool_and(list_transform(st, lambda x: contains(t, ' ' || x))) AS full_name FROM s JOIN v ON contains(t, ' ' || st[1])),
  g AS (SELECT *, bool_or(full_name) OVER (PARTITION BY p_partkey, f) AS any_full FROM m) SELECT DISTINCT p_partkey, grape FROM g WHERE full_name OR NOT any_full""",
    "grape_wishes": f"""WITH {_STEMS}, v AS (SELECT DISTINCT grape, left(lower(grape), greatest(4, length(grape) - 2)) AS st FROM (SELECT unnest([p1, p2]) AS grape FROM w)), s AS (SELECT p_partkey, ' люблю ' || p1 || ' но не люблю ' || r || ' ' AS t, ' ' || r || ' ' AS refused FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN p1 ELSE p2 END AS r FROM w)),
  l AS (SELECT p_partkey, list_sort(list(grape)) AS likes FROM s JOIN v ON contains(t, ' ' || st) GROUP BY ALL), a AS (SELECT p_partkey, list_sort(list(grape)) AS avoids FROM s JOIN v ON contains(refused, ' ' || st) GROUP BY ALL)
  SELECT p_partkey, coalesce(array_to_string(list_filter(likes, lambda x: NOT list_contains(coalesce(avoids, []), x)), ','), '') AS likes, coalesce(array_to_string(avoids, ','), '') AS avoids FROM s LEFT JOIN l USING (p_partkey) LEFT JOIN a USING (p_partkey)""",
    "merge_contexts": f"""WITH {_C}, x AS (SELECT *, {_MAINS} AS mains, {", ".join(f"regexp_matches(t, '{p}') AS {n}" for n, p in _SAID.items())},
    {", ".join(f"{_case('t', rules)} AS {n}" for n, rules in _PICKED.items())} FROM c)
  SELECT conv_id, {", ".join(f"concat_ws(',', {', '.join(f'CASE WHEN bool_or({n}) THEN {v!r} END' for n, v in sorted(values.items(), key=lambda x: x[1]))}) AS {s}" for s, values in _SETS.items())},
    (max_by(said_the, turn) FILTER (said_and))::VARCHAR AS sparkling, CASE WHEN bool_or(no_oak) THEN 'true' END AS avoid_oak, {", ".join(f"max_by({n}, turn) FILTER ({n} IS NOT NULL) AS {n}" for n in ("tannin_pref", "body_pref", "occasion", "budget"))},
    coalesce(max_by(expertise, turn) FILTER (expertise IS NOT NULL), 'novice') AS experience, array_to_string(max_by(mains, turn) FILTER (len(mains) > 0), ',') AS mains FROM x GROUP BY conv_id""",
    "route_intent": f"""WITH {_C}, f AS (SELECT *, regexp_matches(t, 'ering|schung') AS dish, regexp_matches(t, 'tion')::INT + regexp_matches(t, 'heit|ment')::INT AS n FROM c)
  SELECT conv_id, turn, coalesce({_case("t", [(p, "guardrail:" + n) for n, p in RULES.items()])}, CASE WHEN regexp_matches(t, 'whon|eauon') THEN 'feedback' WHEN regexp_matches(t, 'stre') THEN 'label' WHEN n >= 2 AND NOT dish THEN 'compare'
    WHEN regexp_matches(t, 'ouon|ungen') AND n >= 1 THEN 'profile' WHEN dish OR n >= 1 THEN 'recommend' ELSE 'clarify' END) AS intent FROM f""",
}

QUERIES = {f.__name__: f for f in (feature_sweetness, feature_levels, feature_body, aroma_tags, food_mentions, serve_and_alcohol, clean_grapes, extract_features, coverage_report, type_frequency, embed_texts, split_sections, scales_and_snippets, guardrail_code, parse_dish, route_intent, parse_context, grapes_in, grape_wishes, merge_contexts)}
