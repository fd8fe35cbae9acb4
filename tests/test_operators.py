import pytest
from pyspark.sql import functions as F

from tidemark.functions.policies import Policy, parse_policies
from tidemark.operators import admin, filters, index, offline, relay, render, rollup, rules, store

NOW = 1_700_000_000
POINT = "name string, val double, ts long, seq long"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def tree(frame, *leaves):
    return index.nodes_of(frame([(n, i + 2) for i, n in enumerate(leaves)], "name string, id long"))


def test_limits(frame):
    p = frame([("a", 1.0, NOW, 1), ("a" * 301, 1.0, NOW, 2), ("a", 1.0, NOW - 3601, 3), ("a", 1.0, NOW + 3601, 4), ("a.", 1.0, NOW, 5), (None, 1.0, NOW, 6), ("a", 1.0, 0, 7)], POINT)
    assert [r.seq for r in p.filter(filters.passes(300, 3600, 3600, NOW)).orderBy("seq").collect()] == [1]
    why = {r.seq: r.why for r in p.withColumn("why", filters.reason(300, 3600, 3600, NOW)).collect()}
    assert why == {1: None, 2: "length", 3: "age", 4: "future", 5: "invalid", 6: "invalid", 7: "invalid"}


def test_repeats_follow_arrival_not_time(frame):
    p = frame([("a", 1.0, 60, 1), ("a", 2.0, 119, 2), ("a", 3.0, 120, 3), ("a", 4.0, 60, 4), ("b", 5.0, 30, 5)], POINT)
    assert [r.seq for r in filters.drop_repeated(p).orderBy("seq").collect()] == [1, 3, 4]


def test_inner_nodes_take_no_points(frame):
    p = frame([("a", 1.0, 60, 1), ("a.b", 1.0, 60, 2), ("c", 1.0, 60, 3)], POINT)
    assert rows(filters.drop_inner(p, tree(frame, "a.b")), "name") == [("a.b",), ("c",)]
    assert filters.query_blocked("a.*.b", [r"^a\."]) and not filters.query_blocked("b", ["a"])


GRAMMAR = {
    # one segment, and no more, for <f>
    "sum.<f> (60) = sum belt.<f>": {"belt.speed": "sum.speed", "belt.speed.max": None, "belt": None, "x.belt.speed": None},
    # any number of segments for <<f>>, within a text, too
    "sum.<f> (60) = sum belt<<f>>": {"belt3.speed.max": "sum.3.speed.max", "belt": None},
    # * is one segment, or a part of one that may be empty
    "out (60) = sum a.*.z": {"a.b.z": "out", "a.z": None, "a.b.c.z": None},
    "out (60) = sum a.b*d": {"a.bd": "out", "a.bcd": "out", "a.b.d": None},
    # fields are put wherever the output names them, as often as it does
    "<y>.<x>.<y> (60) = sum <x>.v<y>.*": {"left.vright.k": "right.left.right", "left.right.k": None},
    # classes and counts of regular expressions stay what they are
    "odd (60) = sum n[13579]{2}.v": {"n37.v": "odd", "n38.v": None, "n3.v": None},
}


@pytest.mark.parametrize("line", GRAMMAR)
def test_rule_grammar(frame, line):
    rule = rules.parse_rule(line)
    found = {r.name: r.agg for r in rules.match_rules(frame([(n,) for n in GRAMMAR[line]], "name string"), [rule]).collect()}
    assert {n: found.get(n) for n in GRAMMAR[line]} == GRAMMAR[line] == {n: rule.apply(n) for n in GRAMMAR[line]}


def test_rules_are_tried_in_order_until_one_ends_the_search(frame):
    own = rules.parse_rules("first.<f> (60) c = avg wheel.<f>\n# a comment\nsecond (60) c drop = sum *.rim\nthird.<f> (60) DROP = sum wheel.<f>\nnever.<f> (60) = sum *.<f>".replace("DROP", "drop"))
    found = rules.match_rules(frame([("wheel.rim",), ("wheel.hub",), ("tyre.rim",), ("tyre",)], "name string"), own)
    assert rows(found, "name", "rule", "agg", "method", "dropped") == [
        ("tyre.rim", 1, "second", "sum", True), ("tyre.rim", 3, "never.rim", "sum", False),
        ("wheel.hub", 0, "first.hub", "avg", False), ("wheel.hub", 2, "third.hub", "sum", True),
        ("wheel.rim", 0, "first.rim", "avg", False), ("wheel.rim", 1, "second", "sum", True), ("wheel.rim", 2, "third.rim", "sum", True),
    ]


def test_bad_rules():
    for line in ("x (30) = sum y", "x = sum y", "x (60) = median y", "<a> (60) = sum b.<c>"):
        with pytest.raises(ValueError):
            rules.parse_rule(line)


def test_latency_and_custom(frame):
    lags = [7, 1, 12, 40]
    p = frame([("gate.open", 9.5, 180, k, 180 + lag) for k, lag in enumerate(lags)] + [("gate.admin", float(k), 240, k, 240) for k in (2, 6)], POINT + ", arrival long")
    lat = rules.match_rules(p.select("name").distinct(), rules.parse_rules("delay (60) = latency gate.open"))
    assert rows(rules.aggregate(p, lat), "name", "val", "ts") == [("delay.count", 4.0, 180), ("delay.max", 40.0, 180), ("delay.mean", 15.0, 180), ("delay.min", 1.0, 180)]
    custom = rules.match_rules(p.select("name").distinct(), rules.parse_rules("t.<f> (60) = custom1 gate.<f>"))
    # a name that merely ends with the letters "min" is averaged, too
    assert rows(rules.aggregate(p, custom), "name", "val") == [("t.admin", 4.0), ("t.open", 38.0)]


def test_slots_by_brute_force(frame):
    """Sums and means of 60-second slots over names that one rule maps together, against plain Python."""
    names = [f"mill{k % 3}.shaft{k % 5}.load" for k in range(15)]
    p = [(names[k % 15], float(k * 37 % 101), 60 + k * 13 % 400, k) for k in range(200)]
    for method, value in (("sum", sum), ("avg", lambda v: sum(v) / len(v))):
        found = rules.match_rules(frame([(n,) for n in set(names)], "name string"), rules.parse_rules(f"load.<m> (60) = {method} <m>.*.load"))
        held = {}
        for n, v, t, _ in p:
            held.setdefault(("load." + n.split(".")[0], t - t % 60), []).append(v)
        got = {(r.name, r.ts): r.val for r in rules.aggregate(frame(p, POINT), found).collect()}
        assert got == pytest.approx({k: value(v) for k, v in held.items()})


def test_recovery_lateness_is_exact_by_row(frame):
    ts = [610, 900, 1000, 790, 725, 1330, 1140, 1139]
    out = rules.recovery_late(frame([("a", 1.0, t, i) for i, t in enumerate(ts)], POINT), max_slots=3).orderBy("seq").collect()
    top, expected = None, []
    for t in ts:
        expected.append(top is not None and t // 60 < top - 3)
        top = max(t // 60, top or 0)
    assert [r.late for r in out] == expected and {True, False} == set(expected)


def test_running_maximum_over_many_blocks(spark):
    p = spark.range(20_000).select(F.lit("a").alias("name"), F.lit(1.0).alias("val"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("ts"), F.col("id").alias("seq"))
    ts = [r.ts for r in p.orderBy("seq").collect()]
    top, lags, late = None, 0, 0
    for t in ts:
        late += top is not None and t - t % 60 < top - top % 60 - 180
        lags = max(lags, (top or t) - t)
        top = t if top is None else max(top, t)
    assert rules.recovery_late(p).filter("late").count() == late
    assert offline.lag_report(p).first().max_lag == lags


def test_drop_rule_spares_late_points(frame):
    p = frame([("a", 1.0, 60, 1, False), ("a", 1.0, 60, 2, True), ("b", 1.0, 60, 3, False)], POINT + ", late boolean")
    found = rules.match_rules(p.select("name").distinct(), rules.parse_rules("x (60) drop = sum a"))
    assert [r.seq for r in rules.forwarded(p, found).orderBy("seq").collect()] == [2, 3]


def test_rollup_methods(frame):
    methods = rollup.parse_methods("sum = \\.count$\nmin = .*\\Q.min\\E$\nmax = \\.max$\nlast = \\.last$\navg = *")
    p = frame([(f"a.{m}", v, 60 * k, k) for m in ("count", "min", "max", "last", "other") for k, v in enumerate((4.0, 1.0, 3.0))], POINT)
    assert rows(rollup.rollup(p, 300, methods), "name", "val") == [("a.count", 8.0), ("a.last", 3.0), ("a.max", 4.0), ("a.min", 1.0), ("a.other", 8 / 3)]
    assert rows(rollup.rollup(p, 300, methods, last_is_min=True).filter("name = 'a.last'"), "val") == [(1.0,)]
    with pytest.raises(ValueError):
        rollup.parse_methods("median = x")


def test_cascade_averages_averages(frame):
    p = frame([("a", 1.0, 0, 1), ("a", 3.0, 60, 2), ("a", 10.0, 300, 3)], POINT)
    out = rollup.cascade(p, parse_policies())
    assert rows(out["5m7d"], "ts", "val") == [(0, 2.0), (300, 10.0)] and rows(out["30m2y"], "ts", "val") == [(0, 6.0)]


def test_propagate_needs_enough_points(frame):
    p = frame([("a", float(k), 60 * k) for k in range(3)] + [("a", 9.0, 300)], "name string, val double, ts long")
    assert rows(rollup.propagate(p, 60, 300, 0.5)) == [("a", 0, 1.0)]


def test_upsert_keeps_the_last_write(frame):
    policy = Policy.parse("60s:24h")
    p = frame([("a", 1.0, NOW, 1), ("a", 2.0, NOW + 5, 2), ("a", 3.0, NOW - 90_000, 3), ("a.", 4.0, NOW, 4)], POINT)
    first = store.upsert(None, p, policy, NOW)
    start = policy.interval(NOW)
    again = store.upsert(first, frame([("a", 7.0, NOW, 9), ("b", 8.0, NOW, 10)], POINT), policy, NOW)
    assert rows(first, "name", "ts", "val") == [("a", start, 2.0 if policy.interval(NOW + 5) == start else 1.0)] or first.count() == 2
    assert ("a", start, 7.0) in rows(again, "name", "ts", "val") and ("b", start, 8.0) in rows(again, "name", "ts", "val")
    left, gone = store.delete_at(again, policy, NOW + 1)
    assert gone.first().deleted == 2 and left.filter(F.col("ts") == start).count() == 0


def test_archive_table(spark, frame, tmp_path):
    policy = Policy.parse("60s:7d")
    table = store.ArchiveTable(spark, str(tmp_path), policy)
    assert table.read() is None
    table.write(frame([("a", 1.0, NOW, 1), ("a", 2.0, NOW - 86400, 2), ("b", 5.0, NOW, 3)], POINT), NOW)
    table.write(frame([("a", 9.0, NOW, 4)], POINT), NOW)
    t = policy.interval(NOW)
    assert rows(table.read(), "name", "ts", "val") == [("a", t - 86400, 2.0), ("a", t, 9.0), ("b", t, 5.0)]
    assert [r.val for r in table.scan("a", t - 86400, t).collect()] == [2.0, 9.0]
    table.expire(NOW + 7 * 86400)
    assert rows(table.read(), "name", "val") == [("a", 9.0), ("b", 5.0)]


def test_a_later_write_wins_whatever_its_seq(spark, frame, tmp_path):
    policy = Policy.parse("60s:7d")
    table = store.ArchiveTable(spark, str(tmp_path), policy)
    t = policy.interval(NOW)
    for seq, value in ((500_000, 1.0), (0, 2.0), (7, 3.0), (3, 4.0)):
        table.write(frame([("a", value, t, seq), ("a", -1.0, t, seq - 1), ("other.day", 0.5, t - 86400, seq)], POINT), NOW)
        assert rows(table.read(), "name", "val") == [("a", value), ("other.day", 0.5)]


def test_turns_go_round_over_blocks(frame):
    p = frame([("a", 1.0, 60, 10 * k) for k in range(50)], POINT)
    assert [r.turn for r in relay.round_robin(p, 3, block=64).orderBy("seq").collect()] == [k % 3 for k in range(50)]


def test_percentiles_by_brute_force(frame):
    values = [(k % 2, float((k * 7919) % 97 - 30 if k % 3 else 0)) for k in range(300)]
    out = offline.nth_percentile(F.col("ms"), (0, 50, 95, 99), frame(values, "status int, ms double"), ["status"]).collect()
    for r in out:
        own = sorted(v for s, v in values if s == r.status)
        assert (r.p0, r.p50, r.p95, r.p99) == tuple(own[int(len(own) * p / 100)] for p in (0, 50, 95, 99))


def test_import_counts(frame):
    policy = Policy.parse("60s:24h")
    t = policy.interval(NOW)
    lines = frame([("a", f"{t},1.5"), ("a", "60,123"), ("a", "61,123"), ("a", "x"), ("a", f"{t},y"), ("a", None)], "name string, value string")
    points, counts = store.import_lines(lines, policy, NOW)
    assert rows(points) == [("a", t, 1.5)] and tuple(counts.first()) == ("60s24h", 6, 1, 4, 1)
    with pytest.raises(store.TooManyErrors):
        store.import_lines(lines, policy, NOW, max_errors=3)
    with pytest.raises(ValueError):
        store.import_lines(lines, Policy.parse("60s:30d"), NOW)


def test_leaf_conflicts(frame):
    nodes = tree(frame, "a.b.c")
    p = frame([("a.b.c.d", 1.0, 1, 1), ("a.b", 1.0, 1, 2), ("x.y", 1.0, 1, 3), ("x.y.z", 1.0, 1, 4), ("n", 1.0, 1, 5)], POINT)
    out = index.create(nodes, p)
    assert rows(out.filter("is_leaf"), "name", "id") == [("a.b.c", 2), ("n", 3), ("x.y", 4)]
    assert rows(out.filter("NOT is_leaf"), "name") == [("a",), ("a.b",), ("x",)]


def test_search(frame):
    nodes = tree(frame, "a.b.c", "a.b.d", "a.e", "f")
    assert rows(index.find(nodes, "a.*"), "name") == [("a.b",), ("a.e",)]
    assert rows(index.children(nodes), "name") == [("a",), ("f",)] and rows(index.children(nodes, "a.b"), "name") == [("a.b.c",), ("a.b.d",)]
    with pytest.raises(index.TooManyMetrics):
        index.find(nodes, "a.b.*", max_series=1)
    assert index.find(nodes, "*", max_series=1).count() == 2  # one segment: no limit
    assert index.random_metrics(nodes, 2, seed=1).count() == 2


@pytest.mark.parametrize(("leaves", "pattern", "exclude", "leaf_count", "total", "left"), [
    (["a.b.c", "a.b.d", "a.b.e.f", "a.b.e.g"], "a.b.c", [], 1, 1, 6), (["a.b.c", "a.b.d", "a.b.e.f", "a.b.e.g"], "a.b.e", [], 2, 3, 4),
    (["a.b.e.f", "a.b.e.g", "a.b.e.h", "a.b.e.i"], "a.b.e", ["f", "i"], 2, 2, 5), (["a.b.e.f.h", "a.b.x.y.z", "a.b.c.l.m.n"], "a.b", ["f", "l"], 1, 3, 9),
    (["a.b.e.f.h", "a.b.c.l.m"], "a.b", ["h"], 1, 3, 5),
    (["a.b.c.g.k.l", "a.b.c.g.k.n", "a.b.c.g.k.o", "a.b.c.g.f.c.g.k", "a.b.c.g.f.c.g.m.c.g.k", "a.b.c.g.f.c.g.c.g.k.f"], "**.c.g.k", [], 6, 8, 12),
    (["a.b.c.g.k.l", "a.b.c.g.k.n", "a.b.c.g.k.o", "a.b.c.g.f.c.g.k.f"], "**.c.g.k", ["l", "o", "f"], 1, 1, 12),
    (["abc42.d.g.k.n", "abc53.d.g.k.n", "abc73.d.g.k.n", "abc102.d.g.k.n"], "abc*.*.*.*.*", [], 4, 4, 16),
    (["abc42.d.g.klm.n1", "abc53.d.g.klm.n2", "abc73.d.g.klm.n3", "abc102.d.g.klm.n4"], "abc*.*.*.klm", ["n1"], 3, 6, 14),
    (["a.b"], "nothing.here", [], 0, 0, 2),
])
def test_deletes(frame, leaves, pattern, exclude, leaf_count, total, left):
    nodes = tree(frame, *leaves)
    after, counts = index.delete_names(nodes, pattern, exclude)
    assert tuple(counts.first()) == (total, leaf_count)
    assert after.count() == left
    assert index.delete_names(nodes, pattern, exclude, dry_run=True)[0].count() == nodes.count()


def test_subtree_delete(frame):
    nodes = tree(frame, "a.b.c", "a.d")
    with pytest.raises(ValueError):
        index.delete_subtree(nodes, "a.b")
    left, gone = index.delete_subtree(nodes, "a.b", recursive=True)
    assert rows(left, "name") == [("a",), ("a.d",)] and gone.count() == 2


def test_gap_fill_and_guards(frame):
    policies = parse_policies()
    nodes = tree(frame, "a.b", "a.c")
    t = NOW - NOW % 60
    archives = {"60s24h": frame([("a.b", t - 60, 123.0, 1)], "name string, ts long, val double, seq long")}
    q = render.Query("a.*", t - 60, t, t)
    out = {r.name: r["values"] for r in render.render(nodes, archives, q).collect()}
    assert out == {"a.b": [123.0, None], "a.c": [None, None]}
    active = frame([("z",)], "namespace string")
    assert {r.name: r["values"] for r in render.render(nodes, archives, q, active=active).collect()} == {"a.b": [None, None], "a.c": [None, None]}
    with pytest.raises(render.TooManyPoints):
        render.render(nodes, archives, render.Query("a.*", t - 7200, t, t), max_points=100)
    with pytest.raises(render.Blocked):
        render.render(nodes, archives, q, blocked=["^a"])
    none = render.render(nodes, archives, render.Query("a.*", t - 900 * 86400, t, t)).first()
    assert none["values"] == [] and none.step is None
    assert render.estimate_points(render.Query("x", t - 36 * 3600, t - 7200, t), policies, 1) == 408
    assert render.estimate_points(render.Query("x", t - 400 * 86400, t - 7200, t), policies, 1) == 19196
    assert render.is_heavy(render.Query("x", 0, t, t), policies, 1) and not render.is_heavy(q, policies, 1)


def test_find_gives_times(frame):
    out = rows(render.find(tree(frame, "a.b"), "*", NOW))
    assert out == [("a", False, 0, 0)]


def test_half_open_grid(frame):
    p = frame([("a", 60, 1.0), ("a", 120, 2.0)], "name string, ts long, val double")
    assert [(r.ts, r.val) for r in render.half_open(p, "a", 30, 130, 60, 1000, 10_000).orderBy("ts").collect()] == [(60, 1.0), (120, 2.0)]


def test_pages(frame):
    nodes = tree(frame, "a", "b", "c", "d")
    archive = frame([(n, 60, 1.0) for n in "abcd"], "name string, ts long, val double")
    policy = Policy.parse("60s:24h")
    cursor, sizes = 0, []
    for count in (1, 2, 2):
        page, cursor = admin.dump_series(nodes, archive, policy, 0, 1000, cursor=cursor, count=count)
        sizes.append(page.count())
    assert sizes == [1, 2, 1] and cursor is None


def test_stale_series_and_orphans(frame):
    nodes = tree(frame, "old", "new", "none", "bad name")
    archive = frame([("old", NOW - 7200, 1.0), ("new", NOW - 3600, 1.0), ("bad name", NOW, 1.0)], "name string, ts long, val double")
    assert rows(admin.stale_series(nodes, [archive], NOW - 5400), "name") == [("bad name",), ("none",), ("old",)]
    assert rows(admin.orphans(nodes, [archive]), "name") == [("none",)]
    assert rows(admin.orphan_prefixes(nodes, [archive], 1)) == [("none",)]
    with pytest.raises(admin.NoSuchMetric):
        admin.list_points(nodes, archive, name="zzz")
    assert [r.name for r in admin.all_below(tree(frame, "a.b.c", "a.b"), "a").select("name").distinct().orderBy("name").collect()] == ["a", "a.b", "a.b.c"]
    assert rows(admin.parent_leaves(tree(frame, "a.b.c", "a.b")), "name") == [("a.b",)]


def test_routes(frame, tmp_path):
    routes = relay.parse_routes("^a=x:1,y:2|z:3\n^b.=c=null:\nno destination\n# comment")
    assert [(r.pattern, r.groups) for r in routes] == [("^a", (("x:1", "y:2"), ("z:3",))), ("^b.=c", (("null:",),))]
    p = frame([("a1", 1.0, 60, 1), ("a2", 1.0, 60, 2), ("b.=c", 1.0, 60, 3), ("q", 1.0, 60, 4)], POINT)
    out = rows(relay.route(p, routes), "name", "destination")
    assert [d for _, d in out].count("z:3") == 2 and ("b.=c", "null:") in out and not any(n == "q" for n, _ in out)
    sinks, seen = relay.Sinks(), []
    sinks.register("kinesis", lambda df, rest: seen.append((rest, df.count())))
    sinks.write_all(relay.route(p, relay.parse_routes(f"a=kinesis:s|file:{tmp_path}/out\n.*=null:")))
    assert seen == [("s", 2)] and sum(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("part*")) == 2
    assert {r.turn for r in relay.round_robin(p, 3).collect()} == {0, 1, 2}
    assert relay.envelope_batches(p, 2, 99).filter(F.col("lines").startswith("99\n")).count() >= 2


def test_reports(frame):
    distinct = frame([(n,) for n in ("a.b.c", "a.b.d", "a.e", "f")], "name string")
    assert [tuple(r) for r in offline.fan_out(distinct).collect()] == [("a", 1, 2), ("a.b", 2, 2)]
    assert rows(offline.families(distinct, (2,)), "family", "series") == [("a.b", 2), ("a.e", 1)]
    assert rows(offline.positions(distinct, 1), "position", "distinct_values", "is_high") == [(0, 2, True), (1, 2, True), (2, 2, True)]
    assert ("<root>", 2) in rows(offline.drill_down(distinct, 1), "parent", "children")
    log = frame([(f'x "GET /api/a HTTP/1.1" 200 5 "-" "-" {k}',) for k in range(100)] + [("noise",)], "value string")
    stats = offline.request_stats(offline.parse_requests(log)).first()
    assert (stats.requests, stats.p95, stats.p99, stats.max_ms) == (100, 95.0, 99.0, 99.0)
    errors = offline.error_counts(frame([("read: Connection reset by peer",), ("GET http://h/render/x?a timed out",)], "value string"))
    assert rows(errors) == [("reset", "", 1), ("timeout", "/render/x", 1)]


def test_quota_and_namespaces(frame):
    p = frame([("a.x", 1.0, NOW - k, k) for k in range(200)] + [("b.x", 1.0, NOW - 8000, 999)], POINT)
    out = {r.namespace: r.removable for r in index.inactive_namespaces(p, NOW).collect()}
    assert out == {"b": True}
    assert filters.within_quota(p, 3, 10**10).count() == 3


def test_running_values_over_groups_of_blocks(frame):
    from tidemark.functions import running

    blocks = frame([(k, (k * 37) % 11) for k in range(0, 60, 2)], "block long, top long")
    rows = sorted((r.block, r.top) for r in blocks.collect())
    for kind, how in (("max", max), ("sum", sum)):
        got = {r.block: r.earlier for r in running.before(blocks, "block", "top", kind, group=8).collect()}
        assert got == {b: how([t for c, t in rows if c < b]) if b else None for b, _ in rows}
    assert running.before(blocks.limit(0), "block", "top", "sum").collect() == []


def test_request_log_shapes(frame):
    lines = frame([
        ('web:443 10.0.0.1 - kim [1/Jan] "GET /a?b HTTP/1.1" 200 70 "-" "agent"',),
        ('10.0.0.1 - - [1/Jan] "POST /b HTTP/1.1" 304 -',),
        ('10.0.0.1 - - [1/Jan] "GET /c HTTP/1.1" 200 5 "https://h/dashboard/db/sea?x=1" "agent" "-" Len: 31 Rtime: 0.250 Reqs: 2 UPSTR: 10.0.0.2:80 Cache: - POST-DATA: 7.5',),
        ("no request",),
    ], "value string")
    plain = [(r.url, r.status, r.bytes, r.ms) for r in offline.parse_requests(lines, "mellon").collect()]
    assert plain == [("/a?b", 200, 70, None), ("/b", 304, 0, None), ("/c", 200, 5, None)]
    timed = offline.parse_requests(lines, "nginx")
    assert [(r.url, r.ms, r.length, r.bytes, r.dashboard) for r in timed.collect()] == [("/c", 250.0, 31, 5, "sea")]
    assert [tuple(r) for r in offline.dashboard_counts(timed).collect()] == [("sea", 1)]
    stats = offline.request_stats(offline.parse_requests(lines, "mellon"), of="bytes").filter("status = 200").first()
    assert (stats.total_bytes, stats.max_bytes, stats.p95) == (75, 70, 70)


def test_trial_of_random_series(frame):
    now = 1_700_000_000
    until = now - 60
    nodes = frame([("a", False), ("a.x", True), ("a.y", True), ("a.z", True)], "name string, is_leaf boolean")
    points = frame([(n, 1.0, until - until % 60 - 60 * k) for n in ("a.x", "a.y", "a.z") for k in range(5)], "name string, val double, ts long")
    policies = parse_policies("60s:24h")
    (row,) = render.trial(nodes, {policies[0].db: points}, 2, now, policies, seed=3).collect()
    assert row.series == len(row.names) == len(set(row.names)) == 2 and set(row.names) <= {"a.x", "a.y", "a.z"}
    assert row.values == 10 and row.points == 2 * ((row.until - row.until % 60 - (row.start - row.start % 60)) // 60 + 1) and row.until - row.start == 86_280
    (none,) = render.trial(nodes.limit(0), {policies[0].db: points}, 2, now, policies).collect()
    assert (none.series, none.points, none.values, none.names) == (0, 0, 0, [])


@pytest.mark.parametrize("name", ["metrics_json", "render_no_archive"])
def test_queries_answer_more_matches_than_a_request_may(spark, tmp_path, name):
    import __spark_entry__ as entry

    n = index.MAX_SERIES + 1
    events = spark.range(n).selectExpr("id AS event_id", "timestamp'2024-01-30' AS ts", "100000 + id AS user_id", "'click' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()[name](spark, str(tmp_path)).distinct().count() == n
    nodes = spark.range(n).selectExpr("concat('a.b', id) AS name", "true AS is_leaf")  # a request still has its limit
    with pytest.raises(index.TooManyMetrics):
        render.find(nodes, "a.*", NOW)
    with pytest.raises(index.TooManyMetrics):
        render.render(nodes, {}, render.Query("a.*", NOW - 900 * 86400, NOW, NOW))
