"""Tables no larger than the configuration says must not make the edges of the graph move."""

from grafold.operators import coreset, projection, sampling


def test_edges_are_not_shuffled_for_the_coreset_or_the_seeds(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes of checkpoints are unknown when queries are planned
    try:
        edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 1.0), (2, 3, 4.0)], "src long, dst long, weight double")
        nodes = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 7.0), (3, 4.0)], "node long, degree double")
        core = spark.createDataFrame([(0, 0, 0, 1.0, 3.0, 5), (0, 1, 2, 2.0, 7.0, 6)], "trial int, ord int, node long, weight double, degree double, label int")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan(coreset.induced_edges(core, edges))
        assert coreset.induced_edges(core, edges).count() == 2
        query = nodes.selectExpr("node as pos", "node")
        stats = spark.createDataFrame([(0, 5, 1.0, 0.5), (0, 6, 2.0, 0.25)], "trial int, label int, denom double, norm double")
        hits = plan(projection.project(query, core, edges, nodes, 10.0, stats))
        assert hits.count("BroadcastHashJoin") + hits.count("BroadcastNestedLoopJoin") >= 3  # the coreset, its centres, the least of them
        trials = sampling.trials_table(spark, 1, 1)
        base = sampling.base_mass(nodes, 10.0)
        schedule = spark.createDataFrame([(0, 0, 2), (0, 1, 0)], "trial int, step int, node long")
        state = sampling.seeded_state(edges, base, trials, schedule)
        assert plan(state).count("SortMergeJoin") == 1  # only the offers may be as many as the nodes
        assert plan(sampling.smoothed_mass(state)).count("SortMergeJoin") <= 3  # each reads the state; none for owners or totals
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
