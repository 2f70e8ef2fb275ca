from tidemark.operators import events, shape


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def starts(spark, data):
    return spark.createDataFrame(data, "node_id string, thread_id long, op string, op_id long, start_ms long, items long")


def finishes(spark, data):
    return spark.createDataFrame(data, "node_id string, thread_id long, op string, op_id long, finish_ms long, failed boolean")


def test_states_of_pairs(spark):
    s = starts(spark, [("n", 1, "q", 1, 1000, 2), ("n", 1, "q", 2, 400_000, 3), ("n", 1, "q", 3, 900_000, 4), (None, 1, "q", 9, 900_000, 4)])
    f = finishes(spark, [("n", 1, "q", 1, 1500, False), ("n", 1, "q", 7, 10, True)])
    found = events.classify_pairs(s, f, now_ms=1_000_000)
    assert rows(found, "op_id", "state") == sorted([(1, "complete"), (2, "in_flight"), (3, "in_flight"), (7, "orphan_finish"), (9, "in_flight")], key=str)
    assert rows(events.classify_pairs(s, f, now_ms=1_200_000), "op_id", "state")[1] == (2, "expired")
    assert rows(events.pair_events(s, f), "op_id", "latency_ms", "failed") == [(1, 500, False)]
    assert rows(events.pair_counts(found), "state", "n") == [("complete", 1), ("in_flight", 3), ("orphan_finish", 1)]


def test_a_finish_before_its_start_is_no_pair(spark):
    found = events.classify_pairs(starts(spark, [("n", 1, "q", 1, 1000, 2)]), finishes(spark, [("n", 1, "q", 1, 900, False)]), now_ms=1000)
    assert rows(found, "state") == [("in_flight",), ("orphan_finish",)]


def test_shard_metrics_of_an_empty_log(spark):
    assert events.shard_op_metrics(starts(spark, []), finishes(spark, []), dims=["op"]).count() == 0


def test_failure_rate(spark):
    s = starts(spark, [("n", 1, "q", i, 0, 1) for i in range(4)])
    f = finishes(spark, [("n", 1, "q", i, 100 * i, i == 3) for i in range(4)])
    assert rows(events.shard_op_metrics(s, f, dims=["op"]), "bucket", "n", "latency_sum", "failures", "failure_rate") == [(0, 4, 600, 1, 0.25)]


def test_a_thread_ends_an_operation_by_the_next(spark):
    ops = spark.createDataFrame([("n", 1, 1, 10, None), ("n", 1, 2, 30, 35), ("n", 1, 3, 40, None), ("n", 2, 4, 20, None)], "node_id string, thread_id long, op_id long, start_ms long, finish_ms long")
    assert rows(events.implicit_finish(ops), "op_id", "finish_ms") == [(1, 30), (2, 35), (3, None), (4, None)]


def test_polls_give_one_start_and_one_finish(spark):
    polls = spark.createDataFrame([("n", 0, 1000, 1, "create-index [foo_9], cause [api]", 7), ("n", 1, 2000, 1, "create-index", 8), ("n", 2, 3000, None, None, 0)], "node_id string, seq long, poll_ms long, head_order long, source string, age_ms long")
    found = events.poll_to_events(polls)
    assert rows(found, "event", "time_ms", "task", "task_type", "metadata", "age_ms") == [
        ("finish", 2500, 1, None, None, None),
        ("start", 500, 1, "create-index", " [foo_9], cause [api]", 7),
    ]
    assert rows(events.task_runs(found), "task_type", "n", "run_ms", "queue_ms") == [("create-index", 1, 2000, 7)]


def test_a_task_that_comes_again_is_another_run(spark):
    polls = spark.createDataFrame([("n", i, 1000 * i, h, "a", 0) for i, h in enumerate([1, 2, 1, None])], "node_id string, seq long, poll_ms long, head_order long, source string, age_ms long")
    assert rows(events.task_runs(events.poll_to_events(polls)), "n", "run_ms") == [(3, 3000)]


def test_faults_without_a_start_time_are_finishes(spark):
    data = [("follower_check", "1", "a", "b", "100", None, None), ("follower_check", "1", "a", "b", "", "140", "1"), ("leader_check", "2", "a", "b", None, "140", "0")]
    df = spark.createDataFrame(data, "type string, request_id string, source_node string, target_node string, start_ms string, finish_ms string, fault string")
    assert rows(events.fault_metrics(df), "bucket", "type", "n", "latency_avg", "faults") == [(0, "follower_check", 1, 40.0, 1)]


def test_status_of_replies(spark):
    data = [(1, "bulk", "response", 200, None), (2, "search", "failure", 500, "E"), (3, "search", "failure", None, "N"), (4, "other", "response", 200, None), (5, "other", "failure", None, "N")]
    df = spark.createDataFrame(data, "id long, kind string, outcome string, code int, exception string")
    assert rows(shape.response_status(df), "id", "status", "exception") == [(1, 200, ""), (2, 500, "E"), (3, -1, "N"), (5, -1, "N")]
