"""Operators on small inputs with known answers and on inputs with a dominant key."""

import random

from pyspark.sql import functions as F

from telelake.operators import changes, correlate, dependencies, layers, output, routing, schedule, slots


def test_routes(spark):
    routes = spark.createDataFrame(
        [("example.com", "/api/v1", "1"), ("example.com", "/api", "2"), ("example.com", "/", "0"), ("other.com", "api/", "9")],
        "host string, path string, service string",
    )
    cases = {"/api": "2", "/api/v1/users": "1", "/dashboard": "0", "/api-v2": "0", "/api/": "2", "": "0", "/api/v1": "1", "/api/v12": "2"}
    requests = spark.createDataFrame(
        [("example.com", p) for p in cases] + [("other.com", "/x"), ("other.com", "/api/x"), ("none.com", "/")],
        "host string, path string",
    )
    found = {(r.host, r.path): r.service for r in routing.route_join(requests, routes).collect()}
    assert {p: found["example.com", p] for p in cases} == cases
    assert (found["other.com", "/x"], found["other.com", "/api/x"], found["none.com", "/"]) == (None, "9", None)


def test_equal_requests_stay_rows(spark):
    routes = spark.createDataFrame([("h", "/", "s")], "host string, path string, service string")
    requests = spark.createDataFrame([("h", "/a", {"k": 1})] * 3 + [(None, None, None)], "host string, path string, m map<string,int>")
    joined = routing.route_join(requests, routes)
    assert [r.service for r in joined.orderBy("service").collect()] == [None, "s", "s", "s"]
    # Requests are not multiplied: only distinct pairs of host and path are exploded.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    exploded = plan[plan.index("Generate explode") :]
    assert plan.count("Generate explode") == 1 and "Aggregate [host" in exploded


def test_routing_needs_no_nested_loop(spark):
    routes = spark.createDataFrame([("h", "/", "s")], "host string, path string, service string")
    requests = spark.createDataFrame([(1, "h", "/a")], "id int, host string, path string")
    plan = routing.route_join(requests, routes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def slot_case(spark, names, existing, **options):
    keys = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position int")
    held = spark.createDataFrame(existing, "name string, slot bigint")
    return {r.name: r.slot for r in slots.assign_slots(keys, held, **options).collect()}


def test_slots(spark):
    assert slot_case(spark, "abc", []) == {"a": 2, "b": 3, "c": 4}
    assert slot_case(spark, "abc", [("b", 10)]) == {"a": 2, "b": 10, "c": 3}
    assert slot_case(spark, "abc", [("b", 2)]) == {"a": 3, "b": 2, "c": 4}
    assert slot_case(spark, "ab", [("gone", 2), ("b", 3)]) == {"a": 2, "b": 3}
    used = spark.createDataFrame([(2,), (4,)], "slot bigint")
    assert slot_case(spark, "abc", [], in_use=used) == {"a": 3, "b": 5, "c": 6}


def test_slots_against_a_simple_loop(spark):
    rng = random.Random(11)
    names = [f"k{i}" for i in range(400)]
    existing = [(n, s) for n, s in zip(rng.sample(names, 150), rng.sample(range(2, 700), 150), strict=True)]
    expected, used, following = dict(existing), {1, *(s for _, s in existing)}, 2
    for name in names:
        if name not in expected:
            while following in used:
                following += 1
            expected[name] = following
            used.add(following)
    assert slot_case(spark, names, existing, segments=9) == expected


def test_pruning_and_gate_with_a_shared_target(spark):
    services = spark.createDataFrame(
        [(f"s{i}", {"db": "service-healthy", "ghost": "started"}) for i in range(30)]
        + [("db", {}), ("job", {"s1": "completed", "s2": "Started"})],
        "name string, depends_on map<string,string>",
    )
    pruned = {r.name: r.depends_on for r in dependencies.prune_dependencies(services).collect()}
    assert pruned["s3"] == {"db": "healthy"} and pruned["db"] == {}
    assert pruned["job"] == {"s1": "completed", "s2": "started"}
    latest = spark.createDataFrame(
        [("db", "running", "none", None), ("s1", "exited", None, 0), ("s2", "exited", None, 0)],
        "service string, situation string, health string, exit_code int",
    )
    gate = dependencies.dependency_gate(dependencies.prune_dependencies(services), latest)
    ready = {r.service: (r.ready, r.waiting) for r in gate.collect()}
    assert ready["s3"] == (True, 0) and ready["db"] == (True, 0) and ready["job"] == (False, 1)


def test_created_container_counts_as_exited(spark):
    status = spark.createDataFrame(
        [("a", 1, "c", "running", "healthy", None), ("a", 2, "c", "created", "none", 0), ("b", 1, "c", "not_found", "none", None), ("d", 1, "c", "exited", "none", None)],
        "service string, timestamp int, container_id string, state string, health_status string, exit_code int",
    )
    found = {r.service: (r.situation, r.exit_code) for r in dependencies.latest_status(status).collect()}
    assert found == {"a": ("exited", 0), "b": ("not found", None), "d": ("exited", -1)}


def test_digest_outcomes(spark):
    rows = [("i", 1, None), ("i", 2, "a"), ("i", 3, None), ("i", 4, "a"), ("i", 5, "b"), ("j", 1, "x"), ("j", 2, "x")]
    df = spark.createDataFrame(rows, "image string, ts_us bigint, digest string")
    found = {(r.image, r.ts_us): r.outcome for r in changes.digest_changes(df, segments=4).collect()}
    assert found == {
        ("i", 1): "Baseline", ("i", 2): "Updated", ("i", 3): "Deleted", ("i", 4): "NotUpdated", ("i", 5): "Updated",
        ("j", 1): "Baseline", ("j", 2): "NotUpdated",
    }


def firings(spark, cron, start="2024-01-01", end="2024-03-01", **options):
    df = spark.createDataFrame([("s", cron)], "service string, cron string")
    found = schedule.cron_firings(df, start, end, **options)
    return [str(r[0]) for r in found.select(F.timestamp_micros("firing_us").cast("string")).orderBy("firing_us").collect()]


def test_cron_expressions(spark):
    assert firings(spark, "0 0 0 1 * *") == ["2024-01-01 00:00:00", "2024-02-01 00:00:00"]
    assert firings(spark, "0 30 9 * * 0", end="2024-01-10") == ["2024-01-07 09:30:00"]
    assert firings(spark, "0 30 9 * * 1", end="2024-01-10", first_weekday=1) == ["2024-01-07 09:30:00"]
    assert firings(spark, "5,20-22 0 0 29 2 * 2024") == [f"2024-02-29 00:00:{s:02}" for s in (5, 20, 21, 22)]
    assert len(firings(spark, "*/10 * * * * *", end="2024-01-02")) == 8640
    assert firings(spark, "0 10/20 23 31 12 *", end="2025-01-01") == [f"2024-12-31 23:{m}:00" for m in (10, 30, 50)]
    assert firings(spark, "0 0 0 1 1 * 2099") == []
    assert firings(spark, "0 0 2 15 1 *", timezone="Europe/Berlin") == ["2024-01-15 01:00:00"]


def test_cron_names_and_shorthands(spark):
    assert firings(spark, "0 30 9 * * MON-FRI", end="2024-01-08") == firings(spark, "0 30 9 * * 1-5", end="2024-01-08")
    assert len(firings(spark, "0 0 0 * JAN Mon")) == 5 and firings(spark, "0 0 0 * * 7") == firings(spark, "0 0 0 * * sun")
    assert firings(spark, "0 0 0 * * sun", first_weekday=1) == firings(spark, "0 0 0 * * 1", first_weekday=1)
    assert firings(spark, "@daily") == firings(spark, "0 0 0 * * *") and len(firings(spark, "@hourly", end="2024-01-02")) == 24


def test_unreadable_schedules_are_listed(spark):
    bad = ["*/x * * * * *", "*/0 * * * * *", "61 * * * * *", "* * *", "", None, "0 0 0 * * mox", "5-1 * * * * *", "@never", "-1 * * * * *"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate([*bad, "0 0 0 1 * *"])], "service string, cron string")
    assert sorted(int(r.service) for r in schedule.cron_rejects(df).collect()) == list(range(len(bad)))
    assert {r.service for r in schedule.cron_firings(df, "2024-01-01", "2024-02-02").collect()} == {str(len(bad))}


def test_runs_collapse_between_polls(spark):
    fired = spark.createDataFrame([("s", t) for t in (10, 20, 30, 55)] + [("t", 5)], "service string, firing_us bigint")
    polls = spark.createDataFrame([("s", t) for t in (5, 20, 45, 50)], "service string, poll_us bigint")
    found = sorted((r.service, r.poll_us) for r in schedule.cron_runs(fired, polls, segments=5).collect())
    assert found == [("s", 20), ("s", 45)]


def test_duplicates_with_one_dominant_name(spark):
    df = spark.createDataFrame([("x", str(i)) for i in range(40)] + [("y", "p")], "name string, path string")
    found = layers.duplicate_services(df).collect()
    assert len(found) == 40 and {r.uses for r in found} == {40}


def test_strict_keys(spark):
    allowed = {"": ["service", "agent"], "service": ["name"], "agent": ["watch"]}
    docs = ['{"service":{"name":"a"},"agent":{"watch":true}}', '{"service":{"name":"a","x":1}}', '{"x":1}', "{", '{"agent":{"y":1}}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    found = {r.doc: (r.accepted, r.unknown) for r in layers.strict_keys(df, "doc", allowed).collect()}
    assert [found[d] for d in docs] == [(True, ""), (False, "service.x"), (False, "x"), (False, ""), (False, "agent.y")]


def test_strict_keys_inside_lists(spark):
    allowed = {"": ["port"], "port[]": ["host", "map"], "port[].map[]": ["k"]}
    docs = ['{"port":[{"host":1,"bogus":2},{"host":1},"text"]}', '{"port":[]}', '{"port":[{"map":[{"k":1},{"z":1}]}]}', '{"port":{"host":1}}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    found = {r.doc: (r.accepted, r.unknown) for r in layers.strict_keys(df, "doc", allowed).collect()}
    assert [found[d] for d in docs[:3]] == [(False, "port[].bogus"), (True, ""), (False, "port[].map[].z")]


def test_snapshot_diff_of_maps_and_lists(spark):
    kind = "name string, env map<string,string>, ports array<int>, deep struct<m:map<string,array<int>>>"
    new = spark.createDataFrame([("a", {"x": "1", "y": "2"}, [1, 2], ({"k": [1]},)), ("b", {"x": "1"}, [1], None), ("c", None, [1, 2], None)], kind)
    old = spark.createDataFrame([("a", {"y": "2", "x": "1"}, [1, 2], ({"k": [1]},)), ("b", {"x": "2"}, [1], None), ("c", None, [2, 1], None)], kind)
    assert {r.name: r.action for r in changes.config_diff(new, old).collect()} == {"a": "keep", "b": "recreate", "c": "recreate"}


def test_snapshot_diff_compares_nulls(spark):
    new = spark.createDataFrame([("a", None, 1), ("b", "x", 1), ("c", None, 1)], "name string, f string, g int")
    old = spark.createDataFrame([("a", None, 1), ("b", None, 1), ("d", "x", 2)], "name string, f string, g int")
    found = {r.name: r.action for r in changes.config_diff(new, old).collect()}
    assert found == {"a": "keep", "b": "recreate", "c": "start", "d": "remove"}


def test_capture_windows_share_their_boundary_second(spark):
    parsed = spark.createDataFrame([("s", t * 1_000_000, "m") for t in (1, 5, 9, 10)], "service string, timestamp_us bigint, message string")
    marks = spark.createDataFrame([], "service string, mark bigint")
    first = output.increment(parsed, marks, 6)
    marks = output.advance_marks(marks, first, 6)
    assert [tuple(r) for r in marks.collect()] == [("s", 5)]
    second = output.increment(parsed, marks, 11)
    assert sorted(r.timestamp_us for r in second.collect()) == [5_000_000, 9_000_000, 10_000_000]
    columns = ["service", "timestamp_us", "message"]
    assert output.without_repeats(second, first, columns).count() == 2
    untouched = output.advance_marks(marks, second.where("false"), 11)
    assert untouched.first().mark == 5


def test_lines_and_parsing(spark):
    chunks = spark.createDataFrame(
        [(1, "s", "stdout", "2024-01-01T00:00:00.5Z hello world\r\n\nbare\n2026 x y", 7), (2, "s", "stdin", "no", 7)],
        "chunk_id bigint, service string, stream string, text string, observed_us bigint",
    )
    found = output.capture(chunks).orderBy("line_no").collect()
    assert [(r.timestamp_us, r.message) for r in found] == [(1_704_067_200_500_000, "hello world"), (7, "bare"), (7, "x y")]


def test_invalid_utf8_is_replaced(spark):
    chunks = spark.createDataFrame([(1, "s", "stdout", bytearray(b"a\xffb"), 7)], "chunk_id int, service string, stream string, text binary, observed_us bigint")
    assert output.lines(chunks).first().line == "a�b"


def test_tail_limits_before_the_shuffle(spark):
    rows = spark.createDataFrame([("s", i, i) for i in range(100)], "service string, timestamp int, sequence int")
    tail = output.tail(rows, 3)
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.sequence for r in tail.collect()) == [97, 98, 99]


def test_orphans_of_one_missing_parent(spark):
    spans = spark.createDataFrame(
        [("t", f"s{i}", "lost", 1) for i in range(30)] + [("t", "root", None, 9), ("t", "kid", "root", 4)],
        "trace_id string, span_id string, parent_span_id string, duration_ms bigint",
    )
    assert correlate.span_orphans(spans).count() == 30
    found = {r.span_id: (r.children, r.self_ms) for r in correlate.span_children(spans).collect()}
    assert found["root"] == (1, 5) and found["kid"] == (0, 4)


def test_spans_without_ids_share_no_join_key(spark):
    spans = spark.createDataFrame([("", "", None, 3)] * 5 + [("t", "a", None, 9)], "trace_id string, span_id string, parent_span_id string, duration_ms bigint")
    assert sorted(tuple(r) for r in correlate.span_children(spans).collect()) == [("", "", 0, 3)] * 5 + [("t", "a", 0, 9)]


def test_path_filter(spark):
    df = spark.createDataFrame([("a/b",), ("b",), ("ab",), ("/x/a/b",)], "path string")
    assert {r.path for r in changes.service_filter(df, ["b"]).collect()} == {"a/b", "b", "/x/a/b"}
    assert changes.service_filter(df, None).count() == 4
    assert changes.service_filter(df, []).count() == 0


def test_routes_of_a_host_are_never_gathered(spark):
    """A third of all routes and most requests belong to one host."""
    routes = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id"))).alias("host"),
        F.concat(F.lit("/a"), (F.col("id") % 50).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("service"),
    )
    requests = spark.range(2000).select("id", F.lit("hot").alias("host"), F.concat(
        F.lit("/a"), (F.col("id") % 50).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit("/x")).alias("path"))
    joined = routing.route_join(requests, routes)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "LeftSemi" in plan
    rows = joined.collect()
    assert len(rows) == 2000
    assert all(r.service == (f"s{r.id}" if r.id % 3 == 0 else None) for r in rows)


def test_newest_status_needs_no_sort_before_the_first_aggregate(spark):
    rows = [("a", 1, "c1", "running", "healthy", None), ("a", 2, "c1", "dead", "none", 3), ("a", 2, "c2", "exited", "none", None)]
    status = spark.createDataFrame(rows, "service string, t int, container_id string, state string, health_status string, exit_code int")
    status = status.withColumn("timestamp", F.timestamp_seconds("t"))
    latest = dependencies.latest_status(status)
    assert [tuple(r) for r in latest.collect()] == [("a", "exited", None, -1)]
    plan = latest._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[service" in plan.replace("partial_max(timestamp", "")


def test_logs_without_ids_take_no_part_in_the_join(spark):
    logs = spark.createDataFrame([(None, None, "x")] * 500 + [("t", "s", "y"), ("t", None, "z"), ("", "s", "e")], "trace_id string, span_id string, body string")
    spans = spark.createDataFrame([("t", "s", "n", "SERVER", 5), ("", "s", "no", "SERVER", 5)], "trace_id string, span_id string, name string, kind string, duration_ms bigint")
    left = correlate.logs_with_spans(logs, spans, "left").collect()
    assert len(left) == 503
    assert {(r.body, r.span_name) for r in left} == {("x", None), ("y", "n"), ("z", None), ("e", None)}
    assert [r.body for r in correlate.logs_with_spans(logs, spans).collect()] == ["y"]


def test_orphans_by_their_ids(spark):
    rows = [("t", "a", None, "root"), ("t", "b", "a", "x"), ("t", "c", "gone", "y"), ("u", "d", "a", "z"), (None, "e", "a", "w")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string")
    orphans = correlate.span_orphans(spans)
    assert orphans.columns == spans.columns
    assert {r.name for r in orphans.collect()} == {"y", "z", "w"}
