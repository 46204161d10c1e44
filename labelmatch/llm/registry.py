"""Queries of this subpackage: ``opN_<name>(spark, sf_dir)``, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelmatch.functions.storage import spread, table
from labelmatch.llm import alignment, bpe, forest, langid, lattice, licenses, mixing, negatives, pii, pivots, simhash, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffixes": lambda spark, d: suffixes.op1_suffixes(spread(table(spark, d, "documents"))),
        "op2_langid": lambda spark, d: langid.op2_langid(spread(table(spark, d, "documents"))),
        "op3_simhash": lambda spark, d: simhash.op3_simhash(spread(table(spark, d, "documents"))),
        "op4_mixing": lambda spark, d: mixing.op4_mixing(table(spark, d, "documents")),
        "op5_bpe": lambda spark, d: bpe.op5_bpe(spread(table(spark, d, "documents"))),
        "op6_license": lambda spark, d: licenses.op6_license(spread(table(spark, d, "documents"))),
        "op7_near_embeddings": lambda spark, d: pivots.op7_near_embeddings(table(spark, d, "embeddings")),
        "op8_toxicity": lambda spark, d: toxicity.op8_toxicity(spread(table(spark, d, "documents")), table(spark, d, "labels")),
        "op9_pii": lambda spark, d: pii.op9_pii(spread(table(spark, d, "documents"))),
        "op10_nearest": lambda spark, d: forest.op10_nearest(table(spark, d, "embeddings")),
        "op11_negatives": lambda spark, d: negatives.op11_negatives(table(spark, d, "embeddings")),
        "op12_lattice": lambda spark, d: lattice.op12_lattice(spread(table(spark, d, "documents"))),
        "op13_alignment": lambda spark, d: alignment.op13_alignment(spread(table(spark, d, "documents"))),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.oracle_sql(), "op9_pii": pii.oracle_sql(), "op11_negatives": negatives.oracle_sql()}
