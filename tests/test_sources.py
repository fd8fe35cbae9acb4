import gzip
import pickle
import struct

import pytest

from tidemark.operators import relay
from tidemark.sources import binary, dumps, formats, lines


def test_lines(frame):
    texts = ["hub.in.rate 1 1650000300", "  a   2.5   60  ", "a 1", "a 1 2 3", "a x 60", "a 1 1.5", "a NaN 60", "", "a 1 99999999999"]
    out = lines.parse_lines(frame([(t,) for t in texts], "value string")).collect()
    assert [r.ok for r in out] == [True, True, False, False, False, False, True, False, False]
    assert (out[0].name, out[0].val, out[0].ts) == ("hub.in.rate", 1.0, 1650000300) and (out[1].val, out[1].ts) == (2.5, 60)
    assert tuple(lines.counts(lines.parse_lines(frame([(t,) for t in texts], "value string"))).first()) == (9, 6)


def test_gzipped_line_files(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(b"a 1 60\nbad\nb 2 120\n"))
    assert sorted((r.name, r.val, r.ts) for r in lines.read_lines(spark, str(tmp_path)).collect()) == [("a", 1.0, 60), ("b", 2.0, 120)]


def test_series_text(frame):
    p = frame([("door", 720, 8.0), ("door", 726, -1.5), ("door", 727, 0.25), ("door", 733, 8.0)], "name string, ts long, val double")
    line = dumps.series_lines(p, 1).first().line
    assert line == "door|720|1|8,6:-1.5,0.25,13:8"
    back = dumps.parse_series(frame([(line,), ("",), ("ignore.cursor|1|1|2",)], "value string"))
    assert sorted((r.name, r.ts, r.val) for r in back.collect()) == [("door", 720, 8.0), ("door", 726, -1.5), ("door", 727, 0.25), ("door", 733, 8.0)]


def test_pickles(frame, spark, tmp_path):
    bad = [("a", (1, 2)), ("b",), ("c", (1,)), ("d", (60, "12.5")), ("e", (60, "7..2"))]
    body = pickle.dumps(bad, protocol=2)
    content = struct.pack(">I", len(body)) + body + binary.pickle_points([("f", 1.5, 120)]) + b"\0\0"
    out = binary.parse_pickles(frame([(content,)], "content binary")).collect()
    assert sorted((r.name, r.val, r.ts) for r in out if r.name) == [("a", 2.0, 1), ("d", 12.5, 60), ("f", 1.5, 120)]
    assert sum(r.invalid for r in out) == 3
    (tmp_path / "p.bin").write_bytes(content)
    assert binary.read_pickles(spark, str(tmp_path)).count() == 3


def test_pickles_run_no_code():
    class Evil:
        def __reduce__(self):
            return (print, ("no",))

    assert binary.unpickle_points(pickle.dumps([Evil()])) == ([], 1)
    with pytest.raises(pickle.UnpicklingError):
        binary._Plain(__import__("io").BytesIO(pickle.dumps(Evil()))).load()


def test_envelopes(frame):
    record = binary.encode_envelope([("rate7", 1.0, 1655555555), ("m2", 2.5, 60)], 1655555555123)
    broken = gzip.compress(b"not a number\nx 1 1")
    out = binary.decode_envelopes(frame([(record,), (b"junk",), (broken,)], "content binary"))
    parsed = lines.parse_lines(out).filter("ok").collect()
    assert sorted((r.name, r.val, r.ts, r.arrival_ms) for r in parsed) == [("m2", 2.5, 60, 1655555555123), ("rate7", 1.0, 1655555555, 1655555555123)]


def test_archive_files(spark, tmp_path):
    folder = tmp_path / "root" / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "c.wsp").write_bytes(binary.write_archive_file([(60, 5), (300, 4)], {60: [(600, 1.0), (660, 2.0)], 300: [(600, 9.0)]}))
    out = binary.read_archive_files(spark, str(tmp_path / "root"), "root").collect()
    assert sorted((r.name, r.precision, r.ts, r.val) for r in out) == [("a.b.c", 60, 600, 1.0), ("a.b.c", 60, 660, 2.0), ("a.b.c", 300, 600, 9.0)]


def test_answers(frame):
    series = frame([("a", 0, 60, 60, [1.5, None])], "name string, start long, end long, step long, values array<double>")
    found = frame([("a", True, 1, 2), ("b", False, 0, 0)], "path string, is_leaf boolean, start long, end long")
    assert formats.series_json(series).first().value == '{"name":"a","start":0,"end":60,"step":60,"values":[1.5,null]}'
    assert pickle.loads(formats.series_pickle(series)) == [{"name": "a", "start": 0, "end": 60, "step": 60, "values": [1.5, None]}]
    assert pickle.loads(formats.metrics_pickle(found))[1] == {"metric_path": "b", "isLeaf": False, "intervals": [(0, 0)]}
    assert formats.metrics_json(found).count() == 2
    assert formats.msgpack({"a": [1, -1, 300, None, True, 1.5]}) == b"\x81\xa1a\x96\x01\xff\xd3" + struct.pack(">q", 300) + b"\xc0\xc3\xcb" + struct.pack(">d", 1.5)
    assert formats.series_msgpack(series)[:1] == b"\x91" and formats.metrics_msgpack(found)[:1] == b"\x92"
    batch = formats.event_envelope(['{"a":1}', '{"b":2}'])
    assert formats.open_envelope(batch) == [({"version": "1.0"}, '{"a":1}'), ({"version": "1.0"}, '{"b":2}')]
    assert formats.own_metrics({"rows": 3, "rate": {"in put": 1.256}}, "x", 60) == [("x.rows", "3", 60), ("x.rate.in-put", "1.26", 60)]


def test_point_lines(frame):
    p = frame([("a", 0.999, 60, 1), ("b", -0.5, 60, 2)], "name string, val double, ts long, seq long")
    assert [r.value for r in relay.point_lines(p).collect()] == ["a 1 60", "b -0.5 60"]
    assert [r.value for r in relay.point_lines(p, compat=True).collect()] == ["a 0.10 60", "b 0.5 60"]


def test_statistics_of_samples(frame):
    rows = [("wait time", float(k), 1000 + k) for k in range(100)] + [("wait time", None, 1000), ("one", 2.0, 1000)]
    got = {r.name: (r.value, r.ts) for r in formats.sample_statistics(frame(rows, "name string, val double, ts long")).collect()}
    assert got["wait-time.count"] == ("100", 1099) and got["wait-time.mean"] == ("49.50", 1099) and got["wait-time.stddev"] == ("29.01", 1099)
    assert got["wait-time.p95"][0] == "95.00" and got["wait-time.m1_rate"][0] == "1.00" and got["one.stddev"][0] == "0.00" and len(got) == 14


def test_streams_of_pieces_are_one_list(spark):
    from pyspark.sql import functions as F

    series = spark.range(0, 5000, 1, 6).select(F.concat(F.lit("s"), "id").alias("name"), F.lit(0).alias("start"), F.lit(60).alias("end"), F.lit(60).alias("step"), F.array(F.col("id").cast("double"), F.lit(None)).alias("values"))
    pieces = list(formats.series_pickle_stream(series))
    assert len(pieces) > 3 and [(r["name"], r["values"]) for r in pickle.loads(b"".join(pieces))] == [(f"s{k}", [float(k), None]) for k in range(5000)]
    assert pickle.loads(formats.series_pickle(series.limit(0))) == [] and formats.series_msgpack(series)[:5] == b"\xdd" + struct.pack(">I", 5000)
