"""Messages read into requests: dish, wishes, guardrails and intent, as native columns over rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmatch.operators import dishes as D
from labelmatch.operators.features import first_rule, found, hit, let, norm, tags
from labelmatch.operators.lexicon import GUARDRAILS

AXES = ["intensity", "fat", "acid", "sweet", "salt", "heat"]


def parse_dish(text: Column, main=None, modifiers=None, general=None) -> Column:
    """``struct<axes, tags, mains, modifiers, region, styles, course>``, null where no dish is named.

    Axes are the largest among what matches; intensity is the largest of the dishes (2.5 without one) and what
    modifiers add, -0.5 to 0.9, in 0.5 to 4. A general dish gives way to a special one.
    """
    main, modifiers, general = D.MAIN if main is None else main, D.MODIFIERS if modifiers is None else modifiers, D.GENERAL if general is None else general
    asked = [*(p for _, p, _, _ in main), *(p for _, p, _, _, _ in modifiers), *(own for _, own in general.values() if own)]
    return let(norm(text), lambda t: let(F.array(*[found(t, p) for p in asked]), lambda met: _dish(t, dict(zip(asked, map(met.__getitem__, range(len(asked))), strict=True)), main, modifiers, general)))


def _dish(t: Column, met: dict[str, Column], main, modifiers, general) -> Column:
    """The profile of a text by which patterns it has ``met``."""
    raw = {name: met[p] for name, p, _, _ in main}
    on = dict(raw)
    for name, (special, own) in general.items():
        beaten = F.lit(False)
        for s in special:
            beaten = beaten | raw[s]
        on[name] = raw[name] & (~beaten | (met[own] if own else F.lit(False)))
    mod = {name: met[p] for name, p, _, _, _ in modifiers}
    parts = [(on[n], axes, tg) for n, _, axes, tg in main] + [(mod[n], axes, tg) for n, _, axes, tg, _ in modifiers]
    axis = {}
    for a in AXES[1:]:
        axis[a] = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(c, float(x[a])).otherwise(0.0) for c, x, _ in parts if a in x])
    base = F.array_max(F.array_compact(F.array(*[F.when(on[n], float(x["intensity"])) for n, _, x, _ in main])))
    more = sum((F.when(mod[n], d).otherwise(0.0) for n, _, _, _, d in modifiers), F.lit(0.0))
    axis["intensity"] = F.greatest(F.lit(0.5), F.least(F.lit(4.0), F.coalesce(base, F.lit(2.5)) + F.greatest(F.lit(-0.5), F.least(F.lit(0.9), more))))
    named = F.flatten(F.array_compact(F.array(*[F.when(c, F.array(*map(F.lit, tg))) for c, _, tg in parts if tg])))
    every = F.sort_array(F.array_distinct(F.when(axis["heat"] >= 2.5, F.array_append(named, D.HOT_TAG)).otherwise(named)))
    course = F.coalesce(first_rule(t, [(p, n) for n, p in D.COURSES]), F.when(F.array_contains(every, D.DESSERT_TAG), D.DESSERT_TAG))
    mains = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in on.items()]))
    mods = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in mod.items()]))
    profile = F.struct(
        F.struct(*[F.round(axis[a], 1).alias(a) for a in AXES]).alias("axes"),
        every.alias("tags"),
        mains.alias("mains"),
        mods.alias("modifiers"),
        first_rule(t, [(p, n) for n, p in D.CUISINES]).alias("region"),
        tags(t, D.STYLES).alias("styles"),
        course.alias("course"),
    )
    alone = mod.get(D.ALONE, F.lit(False))
    return F.when((F.size(mains) > 0) | alone, profile)


def dish_traits(profile: Column) -> Column:
    """Words for the axes: the band of intensity, then what stands out."""
    a = profile["axes"]
    band = F.when(a["intensity"] <= 0.8, "very light").when(a["intensity"] <= 1.7, "light").when(a["intensity"] <= 2.5, "medium").when(a["intensity"] <= 3.3, "rich").otherwise("very rich")
    more = [(a["fat"] >= 2.5, "fat"), (a["acid"] >= 2, "acid"), (a["sweet"] >= 1.5, "sweet"), (a["salt"] >= 3, "salty")]
    hot = F.when(a["heat"] >= 2.5, "hot").when(a["heat"] >= 1.2, "peppery")
    return F.when(profile.isNotNull(), F.array_compact(F.array(band, *[F.when(c, w) for c, w in more], hot)))


def aroma_links(tag_list: Column) -> tuple[Column, Column]:
    """Aromas that complement and that contrast with the tags of a dish."""
    on = [(F.arrays_overlap(tag_list, F.array(*map(F.lit, need))), a, b) for need, a, b in D.AROMA_LINKS]
    pick = lambda i: F.flatten(F.array_compact(F.array(*[F.when(x[0], F.array(*map(F.lit, x[i]))) for x in on if x[i]])))
    return pick(1), pick(2)


def dish_food_tags(tag_list: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in D.FOOD_TAGS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(tag_list, lambda t: names[t])))


def grapes_in(requests: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, grape)``: varieties named in a message.

    Words are compared by stems of length minus two, four at least, at the start of a word. All varieties of
    a first word count unless one of them is named in full.
    """
    stems = F.transform(F.filter(F.split(F.translate(norm(F.col("grape")), "-", " "), " "), lambda w: w != ""), lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2)))
    vocab = vocabulary.select("grape").distinct().withColumn("stems", stems).where("size(stems) > 0").withColumn("first", F.col("stems")[0])
    words = requests.select(key, F.concat(F.lit(" "), F.regexp_replace(norm(F.col(text)), r"(?U)[^\w]+", " ")).alias("t"))
    lengths = [r.n for r in vocab.select(F.length("first").alias("n")).distinct().collect()]  # of stems: as many as the longest has letters
    begins = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    spoken = F.flatten(F.transform(F.split("t", " "), lambda w: F.transform(F.filter(begins, lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    # A first word has its varieties with it, so a message meets them in one row and nothing of it is sorted.
    known = vocab.groupBy("first").agg(F.collect_list(F.struct("grape", "stems")).alias("of"))
    met = words.select(key, "t", F.explode(F.array_distinct(spoken)).alias("first")).join(known, "first")
    full = F.filter("of", lambda v: (F.size(v["stems"]) > 1) & F.forall(v["stems"], lambda s: F.contains(F.col("t"), F.concat(F.lit(" "), s))))
    named = let(full, lambda f: F.when(F.size(f) > 0, f).otherwise(F.col("of")))
    return met.select(key, F.explode(F.transform(named, lambda v: v["grape"])).alias("grape")).distinct()


def parse_context(text: Column, regions: list[str] = ()) -> Column:
    """``struct`` of wishes; null where a wish is not stated. Regions are named by the first five letters of their first word, or by NAMED_REGIONS.

    The grapes it names need the catalog's: ``with_grapes`` adds them.
    """
    of = lambda use: let(norm(text), use)  # noqa: E731 each wish by itself, so that those not asked for are not worked out
    refusal = "не (?:люблю|хочу|надо|нужно) (красн|бел|розов|оранжев)"
    wanted = lambda t, refused: F.array_compact(F.array(*[F.when(found(t, p) & ~F.array_contains(refused, stem), F.lit(name)) for name, p, stem in D.COLORS]))
    sweet = of(lambda t: F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(found(t, p), F.array(*map(F.lit, levels))) for levels, p in D.SWEET_WISHES]))))))
    named = lambda t: [*((F.contains(t, norm(F.lit(r.split()[0][:5]))), r) for r in regions), *((found(t, p), r) for r, p in D.NAMED_REGIONS)]
    dish = parse_dish(text)
    courses = [(p, n) for n, p in D.COURSES]
    aperitif = F.when((of(lambda t: first_rule(t, courses)) == "аперитив") & (dish["course"] == "аперитив"), "aperitif")
    return F.struct(
        dish.alias("dish"),
        of(lambda t: let(F.regexp_extract_all(t, F.lit(refusal), F.lit(1)), lambda refused: wanted(t, refused))).alias("colors"),
        of(lambda t: F.when(found(t, D.FIZZ), ~found(t, D.NO_FIZZ))).alias("sparkling"),
        let(sweet, lambda levels: F.when(F.size(levels) > 0, levels)).alias("sweet_ok"),
        of(lambda t: F.concat_ws(" ", *[F.regexp_extract_all(t, F.lit(f"(?U){p}"), F.lit(1)) for p in D.AVOIDED])).alias("avoided_text"),
        of(lambda t: found(t, D.NO_OAK)).alias("avoid_oak"),
        of(lambda t: first_rule(t, [(p, n) for n, p in D.TANNIN_WISHES])).alias("tannin_pref"),
        of(lambda t: F.when(found(t, D.LIGHT) & ~found(t, D.LIGHT_FOOD), "light").when(found(t, D.FULL), "full")).alias("body_pref"),
        of(lambda t: F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in named(t)])))).alias("regions"),
        F.coalesce(of(lambda t: first_rule(t, [(p, n) for n, p in D.OCCASIONS])), aperitif).alias("occasion"),
        of(lambda t: hit(t, D.BUDGET)).alias("budget"),
        of(lambda t: F.when(found(t, D.BUDGET), F.array(F.lit(D.BUDGET_NOTE))).otherwise(F.array().cast("array<string>"))).alias("notes"),
        F.coalesce(of(lambda t: first_rule(t, [(p, n) for n, p in D.EXPERIENCE])), F.lit("novice")).alias("experience"),
    )


def with_grapes(requests: DataFrame, vocabulary: DataFrame, key: str, text: str, context: str = "context") -> DataFrame:
    """``requests`` whose ``context`` (of ``parse_context``) also says ``grapes_like`` and ``grapes_avoid``: the varieties a message names, and those it names where it refuses."""
    said, refused = (grapes_in(requests.select(key, F.col(c).alias("t")), vocabulary, key, "t").groupBy(key).agg(F.sort_array(F.collect_set("grape")).alias(to)) for c, to in ((text, "_said"), (f"{context}.avoided_text", "_refused")))
    none = F.array().cast("array<string>")
    joined = requests.join(said, key, "left").join(refused, key, "left")
    avoid = F.coalesce("_refused", none)
    return joined.withColumn(context, F.col(context).withField("grapes_avoid", avoid).withField("grapes_like", F.array_except(F.coalesce("_said", none), avoid))).drop("_said", "_refused")


SETS, SCALARS = ["colors", "sweet_ok", "regions"], ["sparkling", "avoid_oak", "tannin_pref", "body_pref", "occasion", "budget", "experience"]
#: Further sets, and the list whose order counts; joined where a context has them.
MORE_SETS, NOTES = ["grapes_like", "grapes_avoid", "excluded_ids"], "notes"


def merge_contexts(turns: DataFrame, session: str, turn: str, context: str = "context") -> DataFrame:
    """``(session, context)``: sets are joined over the turns; of scalars the last that is stated stays (not false, not novice); likewise the dish; notes follow each other, each once.

    Nothing holds the turns of a session together: the last of what is stated is a maximum by turn, and of sets and notes
    each value is one row, however often it is said, so a session may be of any length. Of equal turns what is stated last by its text stays.
    """
    have = turns.select(f"{context}.*").columns
    said = lambda name: F.col(f"{context}.{name}")

    def last(name: str) -> Column:
        value = said(name)
        text = value.cast("string")
        empty = {"experience": text == "novice", "avoid_oak": text == "false"}.get(name, F.lit(False))
        stated = value.isNotNull() & (F.lit(True) if name == "dish" else (text != "") & ~empty)
        return F.max_by(value, F.when(stated, F.struct(F.col(turn).alias("turn"), F.lit("") if name == "dish" else text))).alias(name)

    sets, notes = [s for s in [*SETS, *MORE_SETS] if s in have], [NOTES] if NOTES in have else []
    ends = turns.groupBy(session).agg(last("dish"), *[last(s) for s in SCALARS])
    kinds = {n: turns.select(said(n)).schema[0].dataType.simpleString() for n in [*sets, *notes]}

    def entries(name: str) -> Column:
        items = F.coalesce(said(name).cast("array<string>"), F.array().cast("array<string>"))
        return F.transform(items, lambda v, i: F.struct(F.lit(name).alias("name"), v.alias("value"), F.struct(F.col(turn).alias("turn"), i.alias("i")).alias("at")))

    listed = ends
    if kinds:
        each = turns.select(session, F.explode(F.concat(*map(entries, kinds))).alias("x")).groupBy(session, "x.name", "x.value").agg(F.min("x.at").alias("at"))
        of = lambda n: F.sort_array(F.collect_list(F.when(F.col("name") == n, F.struct("at", "value"))))  # noqa: E731 distinct values only
        merged = each.groupBy(session).agg(*[F.transform(of(n), lambda x: x["value"]).cast(kinds[n]).alias(n) for n in kinds])
        listed = ends.join(merged, session, "left")
    none = lambda n: F.coalesce(n, F.array().cast(kinds[n]))
    scalars = [(F.coalesce(s, F.lit("novice")) if s == "experience" else F.col(s)).alias(s) for s in SCALARS]
    return listed.select(session, F.struct("dish", *[F.sort_array(none(s)).alias(s) for s in sets], *scalars, *[none(n).alias(n) for n in notes]).alias("context"))


def route_intent(text: Column, has_dish: Column, n_groups: Column, feedback: str, label_info: str, profile: str, rules: dict[str, str] | None = None) -> Column:
    """What a message asks for: a guardrail first, then feedback, label, comparison, profile, recommendation, or a question back."""
    t = norm(text)
    guard = first_rule(t, [(p, f"guardrail:{n}") for n, p in (GUARDRAILS if rules is None else rules).items()])
    other = F.when(found(t, feedback), "feedback").when(found(t, label_info), "label").when((n_groups >= 2) & ~has_dish, "compare").when(found(t, profile) & (n_groups >= 1), "profile").when(has_dish | (n_groups >= 1), "recommend").otherwise("clarify")
    return F.coalesce(guard, other)
