import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmatch.operators import features as X
from labelmatch.operators import lexicon as L
from labelmatch.operators import requests as R
from labelmatch.operators.lexicon import BANNED_TONE, GUARDRAILS

WINES = [
    ("Шардоне брют натур", "shardone", "Белое", "Шардоне", "Танины мягкие, бархат во вкусе, долгий финал. Высокая кислотность, игристое вино, 12-14 °. Алкоголь 12,5%.", 0),
    ("Мускат полусладкий", "muskat", "Белое", "мускат белый, пино черный", "Аромат мёда и персика. Подходит к десертам и фруктам.", 2),
    ("Каберне", "kaberne-suhoe", "Красное", "Каберне Совиньон и Сира (Шираз)", "Плотное мощное вино. Выдержка 12 месяцев в дубе. Терпкие выраженные танины.", 0),
    ("Мерло", "merlo", "Красное", "Молдова / Мерло", "Сладкое вино с ягодным вкусом.", 3),
    ("Рислинг", "risling", "Белое", None, None, None),
]


@pytest.fixture(scope="module")
def wines(spark):
    rows = spark.createDataFrame([w[:5] for w in WINES], "name string, slug string, category string, grape string, description string")
    return {r["name"]: r for r in X.extract_features(rows).collect()}


def test_sweetness_by_name_slug_and_phrase(wines):
    assert [wines[w[0]].features.sweetness for w in WINES] == [w[5] for w in WINES]


def test_levels_body_oak_and_months(wines):
    f = wines["Каберне"].features
    assert (f.tannin, f.oak, f.aging_months, f.sparkling) == (3.5, True, 12, False)
    assert f.body == 4.0
    f = wines["Шардоне брют натур"].features
    assert (f.tannin, f.acidity, f.sparkling, f.alcohol, tuple(f.serve_temp)) == (1.0, 3.5, True, 12.5, (12, 14))
    assert wines["Рислинг"].features.body is None


def test_aroma_food_grapes_and_type(wines):
    f = wines["Мускат полусладкий"].features
    assert f.aroma == ["косточковые", "мёд"] and f.food == ["десерт"]
    assert wines["Мускат полусладкий"].grapes == ["мускат белый", "Пино Нуар"]
    assert wines["Каберне"].grapes == ["Каберне Совиньон", "Сира"] and wines["Мерло"].grapes == ["Мерло"]
    assert wines["Каберне"]["type"] == "красное сухое"
    assert wines["Рислинг"]["type"] == "белое сладость не указана"


def plain_window(text, stem, low, mid, high, win):
    hits = []
    for m in re.finditer(stem, text):
        start, end = m.start() - win, m.end() + win
        seg = text[max(0, start) : end]
        seg = re.sub(r"^\S*\s", "", seg) if start > 0 else seg
        seg = re.sub(r"\s\S*$", "", seg) if end < len(text) else seg
        level = next((v for p, v in ((high, 3.5), (low, 1.0), (mid, 2.0)) if re.search(p, seg)), None)
        hits.append((level is None, len(hits), 2.0 if level is None else level))
    return min(hits)[2] if hits else None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["xx", "lo", "mi", "hi", "abc", " ", "a"]), max_size=25).map(" ".join), min_size=1, max_size=20))
def test_window_level_equals_plain_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(X.window_level(F.col("t"), "xx", "lo", "mi", "hi", 6)["level"]).collect()]
    assert got == [plain_window(t, "xx", "lo", "mi", "hi", 6) for t in texts]


def test_guardrails_in_order_and_tone(spark):
    rows = spark.createDataFrame([("мне 15 лет, я за рулём",), ("я за рулём",), ("не пью",), ("стейк",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.guardrail_code(F.col("t"), GUARDRAILS)).collect()] == ["minor", "driving", "health", None, None]
    tone = spark.createDataFrame([("Не пожалеете, ещё один бокал!",)], "t string").select(X.tone_violations(F.col("t"), BANNED_TONE)).first()[0]
    assert tone == ["не пожалеете", "еще один бокал"]


def test_sections_carry_over_and_snippet(spark):
    rows = spark.createDataFrame([(1, "Intro here. Nose of rose; soft. Taste: long. Still so.")], "k long, t string")
    got = {r.section: r.text for r in X.split_sections(rows, "k", "t", [("nose", "nose"), ("taste", "taste")], "about").collect()}
    assert got == {"about": "Intro here.", "nose": "Nose of rose; soft.", "taste": "Taste: long. Still so."}
    cut = spark.createDataFrame([("One two. Three four five",), ("short",), ("abcdefgh ijklmnop qrst",)], "t string")
    assert [r[0] for r in cut.select(X.snippet(F.col("t"), 12)).collect()] == ["One two.", "short", "abcdefgh…"]


def test_dish_general_gives_way_and_modifiers_add(spark):
    rows = spark.createDataFrame([("жареная рыба",), ("лосось, рыба на гриле",), ("стейк под острым соусом",), ("привет",), ("сыр с плесенью",), ("тирамису на десерт",)], "t string")
    fish, salmon, steak, none, blue, sweet = [r[0] for r in rows.select(R.parse_dish(F.col("t"))).collect()]
    assert fish.mains == ["рыба"] and salmon.mains == ["жирная рыба"] and none is None
    assert steak.axes.heat == 3.0 and "острое" in steak.tags and steak.axes.intensity == 3.9
    assert blue.mains == ["сыр с плесенью"] and sweet.course == "десерт" and sweet.axes.sweet == 2.8


def test_context_wishes(spark):
    rows = spark.createDataFrame([("люблю красное сухое, не люблю танин, без дуба, на свидание",), ("не хочу игристое, белое полусладкое из Крым",)], "t string")
    a, b = [r[0] for r in rows.select(R.parse_context(F.col("t"), ["Крым", "Кубань"])).collect()]
    assert (a.colors, a.sweet_ok, a.tannin_pref, a.avoid_oak, a.occasion) == (["Красное"], [0], "low", True, "date")
    assert (b.sparkling, b.colors, b.sweet_ok, b.regions) == (False, ["Белое"], [2], ["Крым"])


def test_grapes_named_in_full_win(spark):
    vocab = spark.createDataFrame([("Каберне Совиньон",), ("Каберне Фран",), ("Мерло",), ("Мускат белый",)], "grape string")
    asks = spark.createDataFrame([(1, "хочу каберне совиньон и мерло"), (2, "какой-нибудь каберне"), (3, "ничего")], "k long, t string")
    got = {}
    for r in R.grapes_in(asks, vocab, "k", "t").collect():
        got.setdefault(r.k, set()).add(r.grape)
    assert got == {1: {"Каберне Совиньон", "Мерло"}, 2: {"Каберне Совиньон", "Каберне Фран"}}


def test_merge_keeps_what_was_said(spark):
    texts = [(1, 1, "красное, новичок"), (1, 2, "терруар, без дуба"), (1, 3, "белое")]
    rows = spark.createDataFrame(texts, "s long, n int, t string").select("s", "n", R.parse_context(F.col("t")).alias("context"))
    got = R.merge_contexts(rows, "s", "n").first().context
    assert (got.colors, got.experience, got.avoid_oak, got.dish) == (["Белое", "Красное"], "expert", True, None)


def test_sparkling_is_sought_in_the_whole_text(spark, tmp_path):
    from labelmatch.plans import text

    rows = [(1, "x" * 80 + " whst"), (2, "x" * 80), (3, "whst")]
    spark.createDataFrame([(i, t, "src9", "en") for i, t in rows], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.sparkling for r in text.feature_sweetness(spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: True}


def test_window_keeps_its_own_last_line_break(spark):
    """As the SQL of feature_levels: the word cut by the end goes, a line break that is the window's last letter stays."""
    rows = spark.createDataFrame([("xx ab cd\nefgh ijkl",), ("xx ab cde\nfgh ijkl",), ("xx ab c\x0bd efgh",)], "t string")
    got = [r[0] for r in rows.select(X.window_level(F.col("t"), "xx", "lo", "mi", "hi", 7)["quote"]).collect()]
    assert got == ["xx ab\n", "xx ab", "xx ab"]


def test_alternatives_of_letters_are_searched_for_and_find_the_same(spark):
    patterns = [r"a[|]b|c", r"\||ab", r"ab(c|d)|e\b", r"(?<!x)ab\b|bcd", r"abcd?|x", r"abc*|(?i)Q", r"abc{2}|zz", "abc|bcd", r"abc.|\.", "a|", r"[\s-]*q|yyy"]
    texts = ["", "a", "ab", "abc", "abcc", "x ab", "xab", "bcd", "a|b", "e", "yyy", "abcx", "q", ".", "abd zz", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        assert rows.where(~X.found(F.col("t"), p).eqNullSafe(F.col("t").rlike(f"(?U){p}"))).count() == 0, p
    plan = lambda c: rows.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan(X.found(F.col("t"), "abc|bcd")) and "RLIKE" not in plan(X.let(X.norm(F.col("t")), lambda t: X.found(t, "abc|bcd")))
    assert "Contains" not in plan(X.found(X.norm(F.col("t")), "abc|bcd"))  # the text would be worked out for each alternative


def test_messages_are_put_in_lower_case_once_a_wish_and_meet_varieties_without_windows(spark):
    rows = spark.createDataFrame([(1, "Люблю мерло"), (2, "каберне совиньон")], "k long, t string")
    plan = rows.select(R.parse_context(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(t") < 60
    got = R.grapes_in(rows, spark.createDataFrame([("Мерло",), ("Каберне Совиньон",), ("Каберне Фран",)], "grape string"), "k", "t")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "Мерло"), (2, "Каберне Совиньон")]


def test_a_pattern_is_looked_for_only_where_letters_it_needs_stand(spark):
    assert X.needed(r"(the|der|de) [a-z]*(ande|theon)[a-z]*") == ["ande", "theon"]
    assert [X.needed(p) for p in (r"(вино|игристое)?\s*(сухое|брют\w*)", r"((сухое) )?вино", r"(?!сухое)x", r"(вино){0,2}", r"a|(вино)", r"\(вино)", r"(?i)(вино)")] == [[]] * 7
    texts = ["the brande", "the brand", "ande the", "de xtheony", None, "der ande theon"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = r"(the|der|de) [a-z]*(ande|theon)[a-z]*"
    got = {r.i: (r.a, r.b) for r in rows.select("i", X.found(F.col("t"), pattern).alias("a"), F.col("t").rlike(f"(?U){pattern}").alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and [i for i, (a, _) in got.items() if a] == [0, 3, 5]


def test_a_description_is_read_once_for_all_rules_of_sweetness(spark):
    one, many = (str(X.sweetness(F.col("n"), F.col("s"), F.col("d"), replace(L.RUSSIAN, sweetness=L.SWEETNESS[-1:] * k))[0]).count(L.SWEETNESS_PHRASES[1]) for k in (1, 6))
    assert one == many
