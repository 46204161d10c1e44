import __spark_entry__ as entry
from labelmatch.plans import matching as P

DATA = "/root/testdata/sf0.001"


def test_types_keep_five_rows_a_task_and_tables_of_one_part_are_dealt_out(spark):
    assert "WindowGroupLimit" in P.type_fit(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert entry.queries()["augmentation_plan"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = P.dish_rank(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan  # the rules are read before, once


def test_picks_are_explained_by_one_reading_of_the_rules(spark):
    plan = P.explain_pick(spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "contributions" not in plan


def test_alternatives_are_met_by_shuffles_and_read_no_traits_again(spark):
    for query, again in ((P.alternatives, False), (P.alternative_reasons, True)):
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and ("traits" in plan) == again
