import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import config, globs, names, policies
from tidemark.functions.policies import Policy, choose, parse_policies

def legal(name):
    """The rule for names, plainly: segments of letters, digits and _ : = % - with single dots between; nothing below root."""
    segments = name.split(".")
    return all(x and all(c.isascii() and (c.isalnum() or c in "_:=%-") for c in x) for x in segments) and not (segments[0] == "root" and len(segments) > 1)


def test_names_by_brute_force(frame):
    short = ["".join(x) for n in range(5) for x in itertools.product("q7.% ", repeat=n)]
    every = [f"{a}{chr(c)}{b}" for c in range(1, 300) for a, b in (("", ""), ("n", "m"), ("n.", ".m"))]
    roots = ["root", "root.", "root.n", "root.n.m", "Root.n", "rooted.n", "n.root", "n.root.m", "root-.n"]
    rows = [(n, legal(n)) for n in short + every + roots] + [(None, False)]
    out = frame(rows, "name string, expected boolean").withColumn("got", names.is_valid(F.col("name"))).collect()
    assert [r.name for r in out if r.got != r.expected] == [] and 100 < sum(e for _, e in rows) < len(rows) - 100


def test_name_parts(frame):
    n = F.col("name")
    row = frame([("a.b.c",), ("a",)], "name string").select(names.depth(n).alias("d"), names.parent(n).alias("p"), names.namespace(n).alias("ns"), names.ancestors(n).alias("up")).collect()
    assert [tuple(r) for r in row] == [(3, "a.b", "a", ["a", "a.b"]), (1, None, "a", [])]


def java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_hash_is_the_polynomial_of_base_31(frame):
    texts = ["k", "km", "dock4.crane.2.lift", "", "y" * 40, "0.1.2"]
    out = frame([(t,) for t in texts], "name string").select("name", names.java_hash(F.col("name")).alias("h"), names.destination_of(F.col("name"), 3).alias("d")).collect()
    assert {r.name: r.h for r in out} == {t: java_hash(t) for t in texts}
    assert {r.name: r.d for r in out} == {t: abs(java_hash(t)) % 3 for t in texts}


@pytest.mark.parametrize(("value", "plain", "compat"), [(1.0, "1", "1"), (19.04, "19.04", "19.04"), (2.5, "2.5", "2.5"), (0.999, "1", "0.10"), (-0.5, "-0.5", "0.5"), (-3.25, "-3.25", "-3.25"), (0.0, "0", "0"), (100.0, "100", "100"), (float("nan"), "NaN", "0"), (12345678.9, "12345678.9", "12345678.9")])
def test_value_text(frame, value, plain, compat):
    row = frame([(value,)], "v double").select(names.plain_value(F.col("v")).alias("p"), names.compat_value(F.col("v")).alias("c")).first()
    assert (row.p, row.c) == (plain, compat)


def fits(glob, segment):
    """Whether a glob of one segment fits, plainly: alternatives are tried one by one, a star takes any number of characters."""
    if m := re.search(r"\{([^{}]*)\}", glob):
        return any(fits(glob[: m.start()] + x + glob[m.end() :], segment) for x in m[1].split(","))
    if not glob:
        return not segment
    if glob[0] == "*":
        return fits(glob[1:], segment) or bool(segment) and fits(glob, segment[1:])
    return segment[:1] == glob[0] and fits(glob[1:], segment[1:])


def test_globs_by_brute_force(frame):
    made = ["".join(x) for n in range(1, 5) for x in itertools.product("mno", repeat=n)]
    rows = frame([(n,) for n in made], "name string").cache()
    for glob in ("m*", "*o", "m*n", "n{m,o}", "{mm,n*}o", "*{m,no}*", "mno", "*", "m{,n}"):
        got = sorted(r.name for r in rows.filter(globs.glob_matches(F.col("name"), glob)).collect())
        assert got == sorted(n for n in made if fits(glob, n)), glob


def test_glob_stays_within_segments(frame):
    rows = frame([(n,) for n in ("hub", "hub.in", "hub.out", "hub.in.rate", "spoke.in")], "name string")
    pick = lambda p: sorted(r.name for r in rows.filter(globs.glob_matches(F.col("name"), p)).collect())
    assert pick("hub.*") == ["hub.in", "hub.out"] and pick("*.in") == ["hub.in", "spoke.in"] and pick("hub.in") == ["hub.in"] and pick("hub.[io]*") == ["hub.in", "hub.out"]


def test_wildcards_cross_dots(frame):
    rows = frame([("a.b.c",), ("a.bc",), ("x",)], "name string")
    pick = lambda p: sorted(r.name for r in rows.filter(globs.wildcard_matches(F.col("name"), p)).collect())
    assert pick("a*c") == ["a.b.c", "a.bc"] and pick("a?bc") == ["a.bc"] and pick("*") == ["a.b.c", "a.bc", "x"]


def test_policies():
    p = Policy.parse("60s:24h")
    now = 1_700_000_000
    assert (p.precision, p.retention, p.db) == (60, 86400, "60s24h")
    assert not p.includes(now - 25 * 3600, now) and p.includes(now - 23 * 3600, now) and p.includes(now + 999_999, now)
    assert p.max_points(now - 7200, now - 3600, now) == 60 and p.max_points(now + 1, now + 2, now) == 0
    all_ = parse_policies()
    assert [x.db for x in all_] == ["60s24h", "5m7d", "30m2y"]
    assert choose(all_, now - 36 * 3600, now - 7200, now).db == "5m7d" and choose(all_, now - 800 * 86400, now, now) is None
    assert policies.coarser(all_, all_[0]).db == "5m7d" and policies.coarser(all_, all_[2]) is None


def test_config(tmp_path):
    assert config.lines(" a \n\n# b\nc") == ["a", "c"]
    assert config.relative_from("-30d", 10**7) == 10**7 - 30 * 86400 and config.relative_from(-5, 100) == 95 and config.relative_from(5, 100) == 5
    assert config.relative_to(0, 100) == 100 and config.relative_to(-1, 100) == 99
    assert config.changes(["a", "b"], ["b", "c"]) == ({"c"}, {"a"})
    assert config.merge_rules("g", {"x": "i"}, "x", "t") == "t\ni\ng"
    clock = [0.0]
    f = tmp_path / "list"
    f.write_text("1")
    w = config.Watched(str(f), int, 30, lambda: clock[0])
    f.write_text("bad!")
    assert w.get() == 1
    clock[0] = 31
    assert w.get() == 1 and w.revision == 1
    f.write_text("22")
    clock[0] = 62
    assert w.get() == 22 and w.revision == 2


def test_any_match(frame):
    rows = frame([("abc",), ("xyz",), (None,)], "name string")
    assert [r.name for r in rows.filter(config.any_match(F.col("name"), ["^a", "q"])).collect()] == ["abc"]
    assert rows.filter(config.any_match(F.col("name"), [])).count() == 0 and rows.filter(config.any_match(F.col("name"), [".*"])).count() == 3
