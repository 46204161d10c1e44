"""Typed features with evidence from free text: native columns over rules that are data."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.operators.lexicon import RUSSIAN, Lexicon


def norm(text: Column) -> Column:
    """Lower case, ё as е, null as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


#: What is no letter in a pattern, and the letters from which on a pattern's beginning is looked for first.
SIGNS, BEGINNING = r"[\\.^$*+?()\[\]{}]", 3


def alternatives(pattern: str) -> list[str]:
    """What a pattern's outermost bars part; the pattern itself where a bar or a bracket may stand for itself, or the pattern sets how it is read."""
    if re.search(r"\[[^\]]*[()\[|]|\\[()\[\]|Q]|\(\?[a-zA-Z]", pattern):
        return [pattern]
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        parts += [""] if c == "|" and not depth else []
        parts[-1] += "" if c == "|" and not depth else c
    return parts if all(parts) else [pattern]


def needed(part: str) -> list[str]:
    """Letters of which one stands in every match of a pattern that no outermost bar parts: of an outermost group of letters only that must be there; none where there is no such group."""
    if re.search(r"\[[^\]]*[()\[|]|\\[()\[\]|Q]|\(\?[a-zA-Z]", part) or len(alternatives(part)) > 1:
        return []
    best: list[str] = []
    for m in re.finditer(r"\((?:\?:)?([^\\.^$*+?()\[\]{}]+)\)(?![*?{])", part):
        words = m[1].split("|")
        outermost = part[: m.start()].count("(") == part[: m.start()].count(")")
        if outermost and min(map(len, words)) >= BEGINNING and min(map(len, words)) > min(map(len, best), default=0):
            best = words
    return best


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern matches somewhere. Alternatives that are letters only are looked for as such, and others only where the letters they begin with are: a regular expression costs many times a search.

    A text that is neither a column nor the variable of ``let`` is matched as a whole, as it would be worked out for each alternative.
    """
    if "(" in str(text):
        return text.rlike(_u(pattern))
    plain, other = [], []
    for part in alternatives(pattern):
        start = re.split(SIGNS, part)[0]
        if start == part and "|" not in part:
            plain.append(text.contains(part))
            continue
        start = start[:-1] if part[len(start) : len(start) + 1] in ("*", "?", "{") else start
        letters = [start] if len(start) >= BEGINNING and "|" not in start else needed(part)
        other.append(reduce(or_, map(text.contains, letters)) & text.rlike(_u(part)) if letters else text.rlike(_u(part)))
    return reduce(or_, plain + other)


def hit(text: Column, pattern: str) -> Column:
    """The first match, null without one."""
    return F.when(found(text, pattern), F.regexp_extract(text, _u(f"({pattern})"), 1))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def first_rule(text: Column, rules: list[tuple[str, object]]) -> Column:
    """The value of the first rule, in the order given, that matches; null if none does."""
    return F.coalesce(*[F.when(found(text, p), F.lit(v)) for p, v in rules], F.lit(None))


def sweetness(name: Column, slug: Column, description: Column, lex: Lexicon = RUSSIAN) -> tuple[Column, Column]:
    """(level, evidence): by the name, then by parts of the slug, then by a phrase of the description."""
    n, d, parts = norm(name), norm(description), F.split(norm(slug), "-")
    phrase = F.coalesce(*[hit(d, p) for p in lex.sweetness_phrases])
    by_name = first_rule(n, lex.sweetness)
    by_slug = F.coalesce(*[F.when(F.array_contains(parts, t), F.lit(v)) for t, v in lex.sweetness_slug])
    slug_word = F.coalesce(*[F.when(F.array_contains(parts, t), F.lit(t)) for t, _ in lex.sweetness_slug])
    name_word = F.coalesce(*[hit(n, p) for p, _ in lex.sweetness])

    def judge(known: Column) -> Column:
        by_phrase = let(known["phrase"], lambda said: F.struct(said.alias("said"), first_rule(said, lex.sweetness).alias("level")))
        return let(by_phrase, lambda by: F.struct(
            F.coalesce(known["name"], known["slug"], by["level"]).alias("level"),
            F.when(known["name"].isNotNull(), F.concat(F.lit("name: "), name_word)).when(known["slug"].isNotNull(), F.concat(F.lit("slug: "), slug_word)).when(by["level"].isNotNull(), F.concat(F.lit("description: "), by["said"])).alias("evidence"),
        ))

    first = F.struct(by_name.alias("name"), by_slug.alias("slug"))
    # The description is read only where name and slug say nothing, and once for all rules.
    both = let(let(first, lambda f: F.struct(f["name"].alias("name"), f["slug"].alias("slug"), F.when(f["name"].isNull() & f["slug"].isNull(), phrase).alias("phrase"))), judge)
    return both["level"], both["evidence"]


def sparkling(name: Column, slug: Column, description: Column, lex: Lexicon = RUSSIAN) -> Column:
    return found(F.concat_ws(" ", norm(name), F.translate(norm(slug), "-", " "), norm(description)), lex.sparkling)


#: What parts words at the ends of a window; the window's own last line break is none of them.
BLANK = r" \t\n\f\r"


def window_level(text: Column, stem: str, low: str, mid: str, high: str, win: int = 28) -> Column:
    """``struct<level, quote>`` by the words around each place of ``stem``: high 3.5, low 1, mid 2, else 2 unqualified.

    Qualified places come first, then the first place; words cut by the window's ends are left out.
    """
    n = len(stem)
    starts = F.aggregate(
        let(F.split(text, re.escape(stem), -1), lambda p: F.slice(p, 1, F.size(p) - 1)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + n).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")),
        lambda a: a["out"],
    )

    def judge(seg: Column) -> Column:
        level = F.when(found(seg, high), 3.5).when(found(seg, low), 1.0).when(found(seg, mid), 2.0)
        return let(level, lambda v: F.struct(F.coalesce(v, F.lit(2.0)).alias("level"), F.trim(seg).alias("quote"), v.isNotNull().alias("sure")))

    def look(start: Column) -> Column:
        begin = F.greatest(start - win, F.lit(0))
        cut = lambda seg: F.when(start - win > 0, F.regexp_replace(seg, rf"^[^{BLANK}]*[{BLANK}]", "")).otherwise(seg)
        trim = lambda seg: F.when(start + n + win < F.length(text), F.regexp_replace(seg, rf"[{BLANK}][^{BLANK}]*(\n?)\z", "$1")).otherwise(seg)
        return let(let(let(F.substring(text, begin + 1, start + n + win - begin), cut), trim), judge)

    def best(places: Column) -> Column:
        return F.coalesce(F.get(F.filter(places, lambda p: p["sure"]), F.lit(0)), F.get(places, F.lit(0)))

    return let(let(F.transform(starts, look), best), lambda b: F.struct(b["level"].alias("level"), b["quote"].alias("quote")))


def acidity(d: Column, lex: Lexicon = RUSSIAN) -> Column:
    little = F.when(found(d, lex.acidity_diminutive), hit(d, f".{{0,20}}{lex.acidity_diminutive}.{{0,20}}"))
    spoken = F.when(little.isNotNull(), F.struct(F.lit(1.5).alias("level"), F.trim(little).alias("quote")))
    return let(window_level(d, *lex.acidity), lambda level: F.when(level["level"].isNull(), F.coalesce(spoken, level)).otherwise(level))


def body(d: Column, tannin: Column, oak: Column, months: Column, lex: Lexicon = RUSSIAN) -> Column:
    """0.5 to 4: words add or take, up to a cap each; tannin and ageing in oak add; null without any sign."""
    score, signs = F.lit(2.5), []
    for pattern, delta, cap in lex.body:
        n = F.when(~found(d, pattern), 0).otherwise(F.regexp_count(d, F.lit(_u(pattern))))
        part = n * delta
        score = score + (F.greatest(F.lit(-cap), part) if delta < 0 else F.least(F.lit(cap), part))
        signs.append(n > 0)
    middle = found(d, lex.body_middle)
    score = F.when(middle, (score + 2.5) / 2).otherwise(score)
    score = score + F.when(tannin >= 3, 0.6).when(tannin <= 1, -0.2).when(tannin.isNotNull(), 0.1).otherwise(0.0)
    aged = oak & F.coalesce(months >= 6, F.lit(False))
    score = score + F.when(aged, 0.4).otherwise(0.0)
    some = middle | tannin.isNotNull() | aged
    for sign in signs:
        some = some | sign
    return F.when(some, F.greatest(F.lit(0.5), F.least(F.lit(4.0), F.round(score, 2))))


def aging_months(d: Column, lex: Lexicon = RUSSIAN) -> Column:
    months, years = F.regexp_extract(d, _u(lex.months), 1), F.regexp_extract(d, _u(lex.years), 1)
    return F.when(months != "", months.cast("int")).when((years != "") & found(d, lex.ageing), years.cast("int") * 12)


def tags(text: Column, groups: dict[str, str]) -> Column:
    """The sorted names of the groups whose pattern matches."""
    return F.sort_array(F.array_compact(F.array(*[F.when(found(text, p), F.lit(name)) for name, p in groups.items()])))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+|\n+")


def food_mentions(description: Column, lex: Lexicon = RUSSIAN) -> Column:
    """``struct<tags, quote>`` from the sentences that speak of pairing."""
    paired = F.filter(sentences(norm(description)), lambda s: found(s, lex.pairing))
    named = F.filter(F.transform(paired, lambda s: F.struct(tags(s, lex.food).alias("t"), F.trim(s).alias("s"))), lambda x: F.size(x["t"]) > 0)
    quote = F.array_join(named["s"], " | ")
    return F.struct(F.sort_array(F.array_distinct(F.flatten(named["t"]))).alias("tags"), F.when(quote != "", quote).alias("quote"))


def serve_temp(d: Column, lex: Lexicon = RUSSIAN) -> Column:
    low, high = (F.regexp_extract(d, _u(lex.serve), i) for i in (1, 2))
    return F.when(low != "", F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")))


def alcohol(d: Column, lex: Lexicon = RUSSIAN) -> Column:
    each = [F.regexp_extract(d, _u(p), 1) for p in lex.alcohol]
    return F.coalesce(*[F.when(x != "", F.translate(x, ",", ".").cast("double")) for x in each])


def clean_grapes(raw: Column, lex: Lexicon = RUSSIAN) -> Column:
    """Single varieties in the order given: non-varieties go, synonyms become one name, brackets go."""
    alias = F.create_map(*[F.lit(x) for pair in lex.grapes.items() for x in pair])
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r",|\s+и\s+|/"), lambda p: F.trim(p)), lambda p: (p != "") & ~norm(p).isin(lex.not_grapes))
    bare = lambda p: F.regexp_replace(p, r"\s*\(.*?\)", "")
    return F.array_distinct(F.transform(parts, lambda p: F.coalesce(alias[norm(p)], alias[bare(norm(p))], bare(p))))


def wine_type(category: Column, is_sparkling: Column, level: Column) -> Column:
    words = F.when(level == 0, "сухое").when(level == 1, "полусухое").when(level == 2, "полусладкое").when(level == 3, "сладкое").otherwise("сладость не указана")
    return F.concat_ws(" ", F.lower(category), F.when(is_sparkling, "игристое"), words)


def extract_features(catalog: DataFrame, lex: Lexicon = RUSSIAN) -> DataFrame:
    """``catalog(name, slug, category, grape, description, ...)`` with ``features``, ``evidence``, ``grapes`` and ``type``; one projection, no Python."""
    catalog, d = catalog.withColumn("_d", norm(F.col("description"))), F.col("_d")  # a column of its own, worked out once
    level, why = sweetness(F.col("name"), F.col("slug"), d, lex)
    step = catalog.withColumns({"_acid": acidity(d, lex), "_tannin": window_level(d, *lex.tannin), "_oak": found(d, lex.oak), "_months": aging_months(d, lex), "_sweet": level, "_why": why, "_food": food_mentions(d, lex), "_fizz": sparkling(F.col("name"), F.col("slug"), d, lex)})
    features = F.struct(
        F.col("_sweet").alias("sweetness"),
        F.col("_fizz").alias("sparkling"),
        F.col("_acid.level").alias("acidity"),
        F.col("_tannin.level").alias("tannin"),
        F.col("_oak").alias("oak"),
        F.col("_months").alias("aging_months"),
        body(d, F.col("_tannin.level"), F.col("_oak"), F.col("_months"), lex).alias("body"),
        tags(d, lex.aroma).alias("aroma"),
        F.col("_food.tags").alias("food"),
        serve_temp(d, lex).alias("serve_temp"),
        alcohol(d, lex).alias("alcohol"),
    )
    evidence = F.map_from_arrays(F.array(*[F.lit(x) for x in ("sweetness", "acidity", "tannin", "oak", "food")]), F.array("_why", "_acid.quote", "_tannin.quote", hit(d, lex.oak), "_food.quote"))
    out = step.withColumns({"features": features, "evidence": F.map_filter(evidence, lambda _, v: v.isNotNull()), "grapes": clean_grapes(F.col("grape"), lex)})
    return out.withColumn("type", wine_type(F.col("category"), F.col("_fizz"), F.col("_sweet"))).drop("_d", "_acid", "_tannin", "_oak", "_months", "_sweet", "_why", "_food", "_fizz")


def coverage_report(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(feature, n, percent)``: in how many rows each column is not null, and true where it is boolean; one pass."""
    row = df.agg(F.count("*").alias("_all"), *[F.count(F.when(c, 1)).alias(name) for name, c in columns.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in columns)
    return row.selectExpr("_all", f"stack({len(columns)}, {pairs}) as (feature, n)").select("feature", "n", F.round(100 * F.col("n") / F.greatest("_all", F.lit(1)), 1).alias("percent"))


def frequencies(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """``(value, n)``: the ``top`` most frequent values of a column, ties by value; null is one of them."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)


def split_sections(df: DataFrame, key: str, text: str, sections: list[tuple[str, str]], default: str, headings: list[tuple[str, str, bool]] = (), label: str | None = None) -> DataFrame:
    """``(key, place, section, text)``: the sentences of each section in order; ``place`` is that of the section, ``default`` the last.

    A sentence (``;`` ends one too) goes to the section of the ``headings`` pattern it begins with, whatever its case (taken out of it where the
    third value says so and the case is the pattern's), else to the section whose word stands first in it, else to that of the sentence before. A ``label`` it begins
    with goes; it begins with a capital and ends with a stop. Without headings and label sentences stay as they are.
    """
    tidy = bool(headings or label)
    each = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?…;])\s+|\n+" if tidy else r"(?<=[.!?;])\s+|\n+")).alias("pos", "sentence"))
    each = each.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    low = norm(F.col("sentence")) if tidy else F.col("sentence")
    at = [F.struct(F.regexp_instr(low, F.lit(f"(?Ui)({p})")).alias("at"), F.lit(name).alias("name")) for name, p in sections]
    first = F.array_min(F.filter(F.array(*at), lambda s: s["at"] > 0))["name"]
    own = F.coalesce(*[F.when(found(low, f"^{p}"), F.lit(name)) for name, p, _ in headings], first)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = each.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(order), F.lit(default)))
    if tidy:
        said = F.col("sentence")
        for _, p, out in headings:
            said = F.regexp_replace(said, f"(?U)^{p}", "") if out else said
        said = F.trim(F.regexp_replace(F.trim(F.regexp_replace(said, f"(?Ui)^{label}", "") if label else said), r"[;,]+$", ""))
        named = named.withColumn("sentence", said).where("sentence <> ''")
        named = named.withColumn("sentence", F.concat(F.upper(F.substring("sentence", 1, 1)), F.expr("substring(sentence, 2)"), F.when(F.col("sentence").rlike("[.!?…»\"]$"), "").otherwise(".")))
    places = {name: i for i, name in enumerate([*(n for n, _ in sections), default])}
    place = F.coalesce(*[F.when(F.col("section") == name, i) for name, i in places.items()])
    return named.groupBy(key, place.alias("place"), "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("text"))


def scale_profile(level: Column, kind: str) -> Column:
    """0 to 1: sweetness by thirds, the other scales from 1 to 3."""
    share = level / 3 if kind == "sweetness" else (level - 1) / 2
    return F.when(level.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def band(level: Column, low: float, high: float, words: tuple[str, str, str]) -> Column:
    return F.when(level < low, words[0]).when(level < high, words[1]).when(level.isNotNull(), words[2])


def snippet(text: Column, n: int) -> Column:
    """At most ``n`` characters: up to the last sentence end if that is past half, else up to a word, with an ellipsis."""
    head = F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.lit(n))
    end = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1))
    whole = F.length(F.coalesce(text, F.lit(""))) <= n
    return F.when(whole, text).when(end > n / 2, F.substring(head, F.lit(1), end)).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def guardrail_code(text: Column, rules: dict[str, str]) -> Column:
    """The first rule, in order, that matches."""
    return first_rule(norm(text), [(p, name) for name, p in rules.items()])


def tone_violations(text: Column, banned: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(found(norm(text), p), F.lit(p)) for p in banned]))
