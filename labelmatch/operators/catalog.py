"""Pages, searches and lookups of a product table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written


def list_page(products: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first, ties by id; ``total`` is in each row."""
    total = products.agg(F.count("*").alias("total"))
    return products.orderBy(F.desc("created_at"), "product_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


#: Letters of a gram.
GRAM = 3
#: Found rows that a task holds before it keeps only the first ones of each term.
HELD = 100_000


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` letters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _first_rows(found: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """Of each task's rows the first ``k`` of each ``by`` (nulls first), and ``n_found``, which sums up to the number of all; HELD rows and a batch are held at most."""

    def reduced(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[(c, "ascending") for c in (by, *order)], null_placement="at_start")).combine_chunks()
        key = part.column(by)
        new = np.flatnonzero(np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy()])
        place = np.arange(len(part)) - np.repeat(new, np.diff(np.r_[new, len(part)]))
        sums = np.zeros(len(part), np.int64)
        sums[new] = np.add.reduceat(part.column("n_found").to_numpy(), new)
        at = part.schema.get_field_index("n_found")
        return part.set_column(at, part.schema.field(at), pa.array(sums)).filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n > HELD:
                part = reduced(pa.Table.from_batches(held))
                held, n = part.combine_chunks().to_batches(), len(part)
                if n > HELD // 2:  # many terms
                    yield from held
                    held, n = [], 0
        if n:
            yield from reduced(pa.Table.from_batches(held)).to_batches()

    rows = found.withColumn("n_found", F.lit(1).cast("long"))
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


def search_catalog(products: DataFrame, terms: DataFrame, columns: list[str], limit: int, offset: int = 0) -> DataFrame:
    """For each term of ``terms(term)``: ``limit`` products from ``offset`` on, by title and id, with the term in any of the columns; their ``rank``, and how many there are.

    ``%`` and ``_`` in a term are wildcards, a backslash is a letter, and case does not matter. What stands between a term's
    wildcards is cut into runs of three letters (its longest piece itself, where that is shorter; a term of wildcards only has the empty one).
    A product meets the terms whose rarest run it holds, and LIKE decides where it lies: no pairs are gathered or made distinct, and
    each task passes on only the first rows of a term, so that its memory does not grow with the catalog.
    Null terms find nothing; a null column holds nothing; equal terms are one; no rows give no rows.
    """
    pieces = F.filter(F.split(F.lower("term"), "[%_]"), lambda p: p != "")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    long = F.array_distinct(F.flatten(F.transform(pieces, lambda p: _grams(p, GRAM))))
    grams = F.when(F.size(long) > 0, long).otherwise(F.array(F.coalesce(longest, F.lit(""))))
    asked = terms.where("term is not null").select("term").distinct().withColumn("gram", F.explode(grams))
    wanted = written(asked.groupBy("gram").count().select("gram"), "search-grams")
    lengths = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())  # 0 to GRAM
    every = F.array_distinct(F.flatten(F.array(*[F.array(F.lit("")) if n == 0 else _grams(F.lower(c), n) for n in lengths for c in columns] or [F.array().cast("array<string>")])))
    known = products.where("product_id is not null")
    often = known.select(F.explode(every).alias("gram")).join(wanted, "gram", "left_semi").groupBy("gram").count()
    order = Window.partitionBy("term").orderBy(F.coalesce("count", F.lit(0)), "gram")
    rare = written(asked.join(often, "gram", "left").withColumn("r", F.row_number().over(order)).where("r = 1").select("term", "gram"), "search-rarest")
    pattern = F.concat(F.lit("%"), F.replace(F.lower("term"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    has = F.lit(False)
    for c in columns:
        has = has | F.coalesce(F.expr(f"lower(`{c}`) like pattern"), F.lit(False))
    met = known.withColumn("gram", F.explode(every)).join(rare, "gram").withColumn("pattern", pattern).where(has).drop("pattern", "gram")
    found = written(_first_rows(met, "term", ["title", "product_id"], offset + limit), "search-found")
    total = found.groupBy("term").agg(F.sum("n_found").alias("total"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("title", "product_id"))).where(F.col("rank") <= offset + limit)
    return ranked.where(F.col("rank") > offset).drop("n_found").join(total, "term")


def by_id(products: DataFrame, product_id: object) -> DataFrame:
    """The product of an id; no row where it is unknown."""
    return products.where(F.col("product_id") == product_id)


def by_slug(products: DataFrame, slug: str) -> DataFrame:
    """The product of a slug; no row where it is unknown."""
    return products.where(F.col("slug") == slug)


def by_slugs(products: DataFrame, slugs: DataFrame) -> DataFrame:
    """The products of the slugs given; unknown slugs are absent."""
    return products.join(slugs.select("slug").distinct(), "slug", "left_semi")


def with_media_urls(products: DataFrame, columns: list[str], prefix: str = "/api/media/") -> DataFrame:
    return products.withColumns({f"{c}_url": F.concat(F.lit(prefix), F.col(c)) for c in columns})
