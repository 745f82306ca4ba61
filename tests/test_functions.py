"""Scalar functions against known values and properties."""

import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telelake.functions import nested, otlp
from telelake.functions import scalars as S
from telelake.operators import output

GIB, MIB, KIB = 1 << 30, 1 << 20, 1 << 10


def apply(spark, values, kind, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_memory_limits(spark):
    cases = {
        "2g": 2 * GIB, "2G": 2 * GIB, "512m": 512 * MIB, "512M": 512 * MIB, "1024k": MIB,
        "1024K": MIB, "100b": 100, "100B": 100, "1000": 1000, "  10m  ": 10 * MIB,
        "invalid": 0, "": 0, "g": 0, "256mb": 0, "1 g": 0, "+5k": 5 * KIB, "-1m": -MIB, None: None,
    }
    assert apply(spark, cases, "string", S.memory_bytes) == list(cases.values())
    documented = apply(spark, ["256mb", "1GB", "7kb", "5b", "2g"], "string", lambda c: S.memory_bytes(c, "documented"))
    assert documented == [256 * MIB, GIB, 7 * KIB, 5, 2 * GIB]
    with pytest.raises(ValueError):
        S.memory_bytes(F.lit("1"), "other")


def test_nano_cpus(spark):
    cases = {"1.5": 1_500_000_000, "2": 2_000_000_000, ".5": 500_000_000, "x": 1_000_000_000,
             " 2": 1_000_000_000, "": 1_000_000_000, "1e1": 10_000_000_000, None: None, "inf": 2**63 - 1, "nan": 0}
    assert apply(spark, cases, "string", S.nano_cpus) == list(cases.values())


def test_image_references(spark):
    cases = {
        "ubuntu": ("ubuntu", "latest", "docker.io"),
        "ubuntu:20.04": ("ubuntu", "20.04", "docker.io"),
        "localhost:5000/my-image": ("localhost:5000/my-image", "latest", "localhost:5000"),
        "localhost:5000/my-image:1.0": ("localhost:5000/my-image", "1.0", "localhost:5000"),
        "ghcr.io/user/repo@sha256:12345": ("ghcr.io/user/repo", "@sha256:12345", "ghcr.io"),
        "quay.io/coreos/etcd": ("quay.io/coreos/etcd", "latest", "quay.io"),
        "user/repo:": ("user/repo", "", "docker.io"),
        "localhost/x": ("localhost/x", "latest", "localhost"),
    }
    got = apply(spark, cases, "string", lambda c: F.struct(S.image_name(c), S.image_tag(c), S.image_registry(c)))
    assert [tuple(r) for r in got] == list(cases.values())


def test_paths(spark):
    cases = {None: "/", "": "/", "/": "/", "/api": "/api", "/api/": "/api", "api": "/api", "api/": "/api", "//": "/", "a//": "/a/"}
    assert apply(spark, cases, "string", S.normal_path) == list(cases.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=40))
def test_path_properties(spark, paths):
    once = apply(spark, paths, "string", S.normal_path)
    assert all(p.startswith("/") for p in once)
    expected = []
    for p in paths:
        rooted = p if p.startswith("/") else "/" + p
        expected.append(rooted[:-1] if len(rooted) > 1 and rooted.endswith("/") else rooted)
    assert once == expected


def test_dates_truncate_toward_the_epoch(spark):
    day = S.MICROS_PER_DAY
    got = apply(spark, [0, -1, -day, -day - 1, day - 1, day], "bigint", S.date_bucket)
    epoch = datetime.date(1970, 1, 1)
    assert [(d - epoch).days for d in got] == [0, 0, -1, -1, 0, 1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=40))
def test_hex_matches_two_digits_per_byte(spark, values):
    assert apply(spark, values, "binary", S.hex_lower) == ["".join(f"{b:02x}" for b in v) for v in values]


def test_digest(spark):
    good, own = "a" * 64, "b" * 64
    cases = [
        (["r@sha256:" + good + "tail"], "sha256:" + own, good, None),
        (["r"], "sha256:" + own, own, None),
        (["r@sha256:short"], "sha256:" + own, own, None),
        (["r@md5:" + good], "sha256:" + own, None, "invalid digest prefix"),
        (None, "md5:" + own, None, "invalid digest prefix"),
        ([], None, None, "no digest found"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, d array<string>, o string")
    rows = df.select("i", S.image_digest(F.col("d"), F.col("o")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in rows] == [c[2:] for c in cases]


def test_rfc3339(spark):
    base = 1_704_067_200_000_000
    cases = {
        "2024-01-01T00:00:00Z": base,
        "2024-01-01T00:00:00.123456789Z": base + 123456,
        "2024-01-01t02:00:00+02:00": base,
        "2026": None, "2024-01-01": None, "2024-01-01T00:00:00": None, "": None, None: None,
        "2024-13-01T00:00:00Z": None,
    }
    assert apply(spark, cases, "string", S.rfc3339_micros) == list(cases.values())


def test_plain_doubles(spark):
    cases = {1.0: "1", 3.14: "3.14", -2.5: "-2.5", 1.2345678e7: "12345678", 1e20: "1" + "0" * 20,
             1e-5: "0.00001", 1.5e-7: "0.00000015", 123456789.125: "123456789.125", -1e21: "-1" + "0" * 21,
             float("inf"): "inf", float("-inf"): "-inf", 0.0: "0"}
    assert apply(spark, cases, "double", S.plain_double) == list(cases.values())
    assert apply(spark, [float("nan"), -0.0], "double", S.plain_double) == ["NaN", "-0"]


ANY_CASES = [
    ('{"stringValue":"hello"}', '"hello"'),
    ('{"stringValue":"a\\"b\\u0001"}', '"a\\"b\\u0001"'),
    ('{"intValue":"42"}', "42"),
    ('{"intValue":42}', "42"),
    ('{"doubleValue":3.14}', "3.14"),
    ('{"doubleValue":"NaN"}', "null"),
    ('{"doubleValue":"Infinity"}', "null"),
    ('{"doubleValue":"-Infinity"}', "null"),
    ('{"boolValue":true}', "true"),
    ('{"bytesValue":"3q2+7w=="}', '"deadbeef"'),
    ('{"arrayValue":{"values":[{"intValue":"1"},{},{"stringValue":"two"}]}}', '[1,"two"]'),
    ('{"kvlistValue":{"values":[{"key":"key1","value":{"boolValue":false}},{"key":"key2"},{"key":"key3","value":{}}]}}', '{"key1":false}'),
    ('{"arrayValue":{}}', "[]"),
    ("{}", None),
]


def test_any_values(spark):
    def convert(text):
        value = F.from_json(text, otlp.ANY_VALUE)
        texts = F.array_compact(F.array(otlp.nested_text(value)))
        return otlp.any_value_json(value, otlp.nested_lookup(texts, F.size(texts) > 0))

    got = apply(spark, [c[0] for c in ANY_CASES], "string", convert)
    assert [None if g is None else json.loads(g) for g in got] == [None if c[1] is None else json.loads(c[1]) for c in ANY_CASES]


def test_deep_nesting_has_no_limit():
    text = '{"intValue":"7"}'
    for _ in range(60):
        text = '{"arrayValue":{"values":[' + text + "]}}"
    assert nested.translate(text) == "[" * 60 + "7" + "]" * 60


def test_key_values(spark):
    cases = {
        "[]": None,
        '[{"key":"none"},{"key":"empty","value":{}}]': "{}",
        '[{"key":"k1","value":{"stringValue":"v1"}},{"key":"n1"},{"key":"n2","value":{}},{"key":"k2","value":{"intValue":"42"}}]': '{"k1":"v1","k2":42}',
        '[{"key":"k","value":{"intValue":"1"}},{"key":"a","value":{"boolValue":true}},{"key":"k","value":{"stringValue":"last"}}]': '{"a":true,"k":"last"}',
    }

    def convert(text):
        return otlp.key_values_json(F.from_json(text, otlp.KEY_VALUES))

    assert apply(spark, cases, "string", convert) == list(cases.values())


def test_scalar_attributes_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("[]",)], "t string")
    plan = df.select(otlp.key_values_json(F.from_json("t", otlp.KEY_VALUES)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_service_name(spark):
    s, i = '{"key":"service.name","value":{"stringValue":"%s"}}', '{"key":"service.name","value":{"intValue":"1"}}'
    cases = {"[]": "unknown", f"[{s % 'a'},{s % 'b'}]": "b", f"[{s % 'a'},{i}]": "a", f"[{i}]": "unknown", None: "unknown"}
    got = apply(spark, cases, "string", lambda t: otlp.service_name(F.from_json(t, otlp.KEY_VALUES)))
    assert got == list(cases.values())


def cut(line):
    raw = line.encode()
    return line if len(raw) <= 4096 else raw[:4096].decode(errors="ignore") + "...[TRUNCATED]"


def test_truncation_respects_characters(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀"]
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1000, 4200))) for _ in range(60)]
    lines += ["a" * n + c * 2 for n in range(4090, 4098) for c in alphabet]
    assert apply(spark, lines, "string", output.truncate) == [cut(x) for x in lines]


def test_enum_codes_are_null_for_unknown_names(spark):
    assert apply(spark, ["Cron", "Nope", None], "string", S.trigger_code) == ["cron", None, None]
    assert apply(spark, ["never", "OnFailure"], "string", S.restart_code) == ["no", "on-failure"]
    assert apply(spark, ["NotFound", "Dead"], "string", S.state_code) == ["not_found", "dead"]
    assert apply(spark, [0, 3, 9], "int", S.span_kind) == ["UNSPECIFIED", "CLIENT", "UNSPECIFIED"]
    assert apply(spark, [None, 1, 7], "int", S.span_status) == ["UNSET", "OK", "UNKNOWN"]
