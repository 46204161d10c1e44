"""Personal data: patterns, and terms that reveal them (information-theoretic sanitisation).

Patterns find the protected entities. For each entity that stands in more than one distinct
text, documents are counted over the whole corpus: with the entity, with a term, with both. A
term discloses the entity by PMI(entity; term) / IC(entity), which is 1 if the term never stands
without the entity. From ``GENERALISE`` on a term is replaced by a placeholder, from ``REMOVE``
on it is removed, in the documents that hold the entity. Everything is DataFrame and SQL functions.

The patterns are written without nested repetitions, which Java's engine would recurse into:
marks that cannot belong to a match are first replaced, one character by one, so that a single
character class covers the rest. ``\\G`` lets a match begin where the one before ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmatch.functions.storage import written

KINDS = ["email", "ip", "card", "phone"]
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Letters of a term, and distinct texts an entity needs for its counts to say anything.
TERM_LETTERS, SUPPORT = 4, 2
#: Rows, and bytes of keys, up to which a table of entities or terms is broadcast; parts that it is dealt out in beyond.
MAX_BROADCAST, MAX_BYTES, SALT = 100_000, 1 << 24, 16

_LOCAL = r"A-Za-z0-9._%+\x01-"
#: kind: a cheap test, the text with marks that cannot match replaced, the pattern, the test of a match m.
_RULES = {
    "email": (
        "contains({t}, '@')",
        r"regexp_replace(translate({t}, '\u0001', '\u0002'), r'\.(?![A-Za-z0-9-])', '\u0001')",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
        "true",
    ),
    "ip": (
        r"{t} rlike r'[0-9]\.[0-9]'",
        "{t}",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$'",
    ),
    "card": (
        r"{t} rlike r'[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]'",
        r"regexp_replace({t}, r'(?<![0-9])[\x20-]|[\x20-](?![0-9])', '\u0001')",
        r"[0-9][0-9\x20-]*+",
        "length(regexp_replace(m, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))",
    ),
    "phone": (
        "contains({t}, '+')",
        "{t}",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "length(regexp_replace(m, '[^0-9]', '')) between 8 and 15",
    ),
}
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _places(text: str, pattern: str, kind: str, test: str) -> str:
    """SQL: the matches of ``pattern`` with their code points, by the lengths of what stands between them."""
    step = f"""(a, x) -> struct(a.at + length(x.gap) + length(x.m) as at,
        concat(a.out, array(struct('{kind}' as kind, a.at + length(x.gap) as start, a.at + length(x.gap) + length(x.m) as end, x.m as value))) as out)"""
    pairs = f"zip_with(slice(split({text}, r'{pattern}', -1), 1, size(ms)), ms, (g, m) -> struct(g as gap, m as m))"
    spans = f"aggregate({pairs}, struct(0 as at, cast(array() as {_SPAN}) as out), {step}, a -> a.out)"
    every = f"transform(array(regexp_extract_all({text}, r'{pattern}', 0)), ms -> if(size(ms) = 0, cast(array() as {_SPAN}), {spans}))[0]"
    return f"filter({every}, s -> {test.replace('(m,', '(s.value,').replace('m rlike', 's.value rlike')})"


def base_spans(text: str) -> Column:
    """The pattern spans of the SQL expression ``text`` (null: empty), by kind as listed, then start; ends are exclusive."""
    t = f"coalesce({text}, '')"
    parts = [f"if({when.format(t=t)}, {_places(shown.format(t=t), pattern, kind, test)}, cast(array() as {_SPAN}))" for kind, (when, shown, pattern, test) in _RULES.items()]
    return F.expr(f"concat({', '.join(parts)})")


def _words(text: str) -> str:
    """SQL: the distinct words of a text, as they are written."""
    return rf"array_distinct(regexp_extract_all({text}, r'\p{{L}}+', 0))"


def _terms(text: str) -> str:
    return f"array_distinct(transform(filter({_words(text)}, w -> length(w) >= {TERM_LETTERS}), w -> lower(w)))"


def _met(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` (with ``n``) joined with ``few``, where one key may hold any share of ``many``: ``few`` is broadcast if it is within the bounds, else dealt out SALT times and merged.

    The merge is asked for: by the size of its file, in which equal keys are packed, Spark would take the dealt-out table for small and collect it in the driver.
    """
    rows, size = few.limit(MAX_BROADCAST + 1).select(F.count("*"), F.sum(sum((F.octet_length(k) for k in keys), F.lit(0)))).first()
    if rows <= MAX_BROADCAST and (size or 0) <= MAX_BYTES:
        return many.join(F.broadcast(few), keys)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    return many.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALT)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``(n, term, share)``: the terms of a row of ``found(n, text, spans)`` that disclose one of its entities, by the counts over all of ``docs``."""
    held = found.select("n", F.xxhash64("text").alias("h"), F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))).alias("entities"), F.expr(_terms("text")).alias("terms"))
    single = written(held.select("n", "h", F.explode("entities").alias("entity"), "terms"), "pii-entities")
    known = single.groupBy("entity").agg(F.count("*").alias("n_e"), F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("entity", "n_e")  # SUPPORT: two distinct texts
    each = _met(single.select("n", "entity", "terms"), written(known, "pii-known"), ["entity"]).select("n", "entity", "n_e", F.explode("terms").alias("term"))
    both = each.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_both")).where(f"n_both >= {SUPPORT}")
    every = docs.select(F.explode(F.expr(_terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.count()
    share = F.round(F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e")), 9)
    revealing = both.join(every, "term").where(F.col("n_e") < total).select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    return _met(each.select("n", "entity", "term"), written(revealing, "pii-revealing"), ["entity", "term"]).groupBy("n", "term").agg(F.max("share").alias("share"))


def _term_spans(text: str, terms: str) -> str:
    """SQL: the words of a text that are, in lower case, keys of ``terms``, with their code points.

    The pattern lists the words as they are written in this text, so that only these are spans, whatever lower-casing does to lengths.
    """
    pattern = rf"concat(r'(?<!\p{{L}})(?:', array_join(filter({_words(text)}, w -> map_contains_key({terms}, lower(w))), '|'), r')(?!\p{{L}})')"
    found = _places(text, "@", "term", "true").replace("r'@'", pattern)
    return f"if(size({terms}) = 0, cast(array() as {_SPAN}), {found})"


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row struct of all columns of docs, text, spans, terms)`` for each row of ``docs``.

    ``spans`` are the pattern spans, then the spans of kind ``term``; ``terms`` maps each disclosing
    term to its share. Null and empty texts have no spans; repeated rows give repeated rows and
    count as documents, but not as distinct texts; of two entities a term discloses, the larger share
    counts; no rows give no rows; further columns are carried in ``row`` whatever their names; texts of
    any length are searched whole.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    marked = rows.withColumn("spans", base_spans("text"))
    found = written(marked.where("size(spans) > 0").withColumn("n", F.monotonically_increasing_id()), "pii-found")
    per_row = disclosures(found, rows).groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))  # at most the words of the row
    empty = F.expr("cast(map() as map<string,double>)")
    hit = found.join(per_row, "n", "left").withColumn("spans", F.expr(f"if(terms is null, spans, concat(spans, {_term_spans('text', 'terms')}))"))
    clear = marked.where("size(spans) = 0").select("row", "text", "spans", empty.alias("terms"))
    return clear.unionByName(hit.select("row", "text", "spans", F.coalesce("terms", empty).alias("terms")))


def sanitised(remove: float = REMOVE) -> Column:
    """The text of an annotated row: pattern spans become [KIND], terms [TERM] or nothing; a span that begins inside another is part of it."""
    tag = f"case when s.kind <> 'term' then concat('[', upper(s.kind), ']') when terms[lower(s.value)] >= {remove} then '' else '[TERM]' end"
    step = f"""(a, s) -> struct(greatest(a.at, s.end) as at,
        if(s.start >= a.at, concat(a.out, substring(text, a.at + 1, s.start - a.at), {tag}), a.out) as out)"""
    order = "array_sort(spans, (l, r) -> case when l.start <> r.start then l.start - r.start else r.end - l.end end)"
    built = f"aggregate({order}, struct(0 as at, '' as out), {step}, a -> concat(a.out, substring(text, a.at + 1)))"
    return F.expr(f"if(size(spans) = 0, text, {built})")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text sanitised.

    Null texts stay null and empty ones empty; of spans that begin at one place the longest is replaced, and what begins
    inside a replaced span goes with it; repeated rows give repeated rows; no rows give no rows.
    """
    out = annotate(docs, text_col=text_col).withColumn("clean", sanitised())
    return out.select(*[(F.col("clean") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_pii(docs: DataFrame) -> DataFrame:
    out = annotate(docs.select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _places_sql(source: str, number: int, kind: str, pattern: str, test: str) -> str:
    return f"""SELECT * FROM (SELECT n, {number} AS k, '{kind}' AS kind, i, m, (sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s
      FROM (SELECT n, unnest(range(len(ms))) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m FROM (SELECT n, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM {source}))
      WINDOW w AS (PARTITION BY n ORDER BY i)) WHERE {test}"""


def oracle_sql(documents: str = "documents") -> str:
    """The same by DuckDB: the patterns as they are stated, counts over all rows, places by what stands between matches."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: (substr({digits}, (length({digits}) - i)::BIGINT, 1)::INT * (1 + i % 2)) - CASE WHEN i % 2 = 1 AND substr({digits}, (length({digits}) - i)::BIGINT, 1)::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
    octets = "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(nullif(left(ltrim(x, '0'), 3), '')::INT, 0) <= 255))"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", octets),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    words = r"\p{L}+"
    base = " UNION ALL ".join(_places_sql("d", i, kind, pattern, test) for i, (kind, pattern, test) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM {documents}),
base AS ({base}),
terms AS (SELECT DISTINCT n, lower(unnest(list_filter(regexp_extract_all(t, '{words}'), lambda w: length(w) >= {TERM_LETTERS}))) AS term FROM d),
entities AS (SELECT DISTINCT n, kind || ':' || m AS entity FROM base),
known AS (SELECT entity, count(*) AS n_e FROM entities JOIN d USING (n) GROUP BY entity HAVING count(DISTINCT t) >= {SUPPORT}),
pairs AS (SELECT entity, n_e, term, count(*) AS n_both FROM entities JOIN known USING (entity) JOIN terms USING (n) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
seen AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term), total AS (SELECT count(*)::DOUBLE AS total FROM d),
shares AS (SELECT entity, term FROM pairs JOIN seen USING (term), total WHERE n_e < total AND round(ln(n_both * total / (n_e * n_t)) / ln(total / n_e), 9) >= {GENERALISE}),
told AS (SELECT DISTINCT n, term FROM shares JOIN entities USING (entity) JOIN terms USING (n, term)), holders AS (SELECT n, t FROM d WHERE n IN (SELECT n FROM told)),
every AS (SELECT n, k, kind, m, s FROM base UNION ALL SELECT n, k, kind, m, s FROM ({_places_sql("holders", 4, "term", words, "true")}) w WHERE (n, lower(m)) IN (SELECT n, term FROM told)),
shown AS (SELECT n, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || s || ':' || s + length(m), ',' ORDER BY k, s) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || s + length(m), ',' ORDER BY k, s) AS a FROM every GROUP BY n)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN shown USING (n)
"""
