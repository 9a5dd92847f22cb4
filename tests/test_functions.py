import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import guards, parsing, patterns

NAME = st.from_regex(r"[a-z][a-z0-9_]{0,5}", fullmatch=True)
VALUE = st.from_regex(r"[A-Za-z0-9.%]{1,6}", fullmatch=True)


@given(st.dictionaries(NAME, VALUE, min_size=1, max_size=4), st.from_regex(r"[/_+=.]{1,3}", fullmatch=True))
def test_fill_then_match(wildcards, between):
    between = "/" + between
    pattern = patterns.parse_pattern("in" + between + between.join(f"{{{n}}}" for n in wildcards))
    assert patterns.match(pattern, patterns.fill(pattern, wildcards)) == dict(sorted(wildcards.items()))


@settings(max_examples=200)
@given(st.text("{}ab/", max_size=12))
def test_parse_never_loses_text(raw):
    try:
        pattern = patterns.parse_pattern(raw)
    except patterns.PatternError:
        return
    assert "".join("{" + v + "}" if k == "wild" else v for k, v in pattern.pieces) == re.sub(r"\{\{(.*?)\}\}", r"{\1}", raw, flags=re.S)  # what is escaped stays as it is, further braces too


@pytest.mark.parametrize("bad", ["{", "}", "{}", "a{b", "{a}{b}", "{a-b}", "{{x}", "x}}"])
def test_bad_patterns(bad):
    with pytest.raises(patterns.PatternError):
        patterns.parse_pattern(bad)


def test_repeated_wildcards_and_constraints():
    p = patterns.parse_pattern("{s}/out_{s}.{{x}}")
    assert patterns.match(p, "a/out_a.{x}") == {"s": "a"} and patterns.match(p, "a/out_b.{x}") is None
    assert patterns.match(patterns.parse_pattern("{s}.csv"), "b.csv", {"s": "a|b"}) == {"s": "b"}
    assert patterns.match(patterns.parse_pattern("{s}-{t}.csv"), "a-b.csv", {"s": "(a|b)+"}) == {"s": "a", "t": "b"}
    with pytest.raises(patterns.PatternError):
        patterns.check_constraint("s", "(?=a)")


def test_columns_agree_with_the_driver(spark):
    p = patterns.parse_pattern("{a}/{b}_{a}.csv")
    paths = ["x/y_x.csv", "x/y_z.csv", "x/y.csv", "", "q/1_q.csv", "x/y_x.csv\n"]
    rows = spark.createDataFrame([(s,) for s in paths], "path string").select("path", patterns.resolve(p, F.col("path")).alias("w"), patterns.interpolate(p, patterns.resolve(p, F.col("path"))).alias("back")).collect()
    for r in rows:
        assert r.w == patterns.match(p, r.path) and r.back == (r.path if r.w else None)
    w = {"b": "1-2", "a": "x%y"}
    got = spark.range(1).select(patterns.job_id(F.lit("r"), F.create_map(*[F.lit(x) for kv in w.items() for x in kv]))).first()[0]
    assert got == patterns.job_id_of("r", w) == "r-x%25y-1%2D2"


@pytest.mark.parametrize(("expression", "fits", "doesnt"), [("[(]x", "(x", "?x"), ("[^(]x", "ax", "(x"), ("(?P<n>a|b)c", "bc", "c"), ("(?<n>a)(b)?", "ab", "b"), (r"\(a\)", "(a)", "a"), ("[](]+", "](", "a")])
def test_groups_of_constraints(spark, expression, fits, doesnt):
    p = patterns.parse_pattern("{s}.{t}")
    rows = spark.createDataFrame([(f"{x}.end",) for x in (fits, doesnt)], "path string").select("path", patterns.resolve(p, F.col("path"), {"s": expression}).alias("w")).collect()
    for r, want in zip(rows, (fits, None), strict=True):
        assert r.w == patterns.match(p, r.path, {"s": expression}) == ({"s": want, "t": "end"} if want else None)


def test_command_goes_from_specific_to_bare():
    text = patterns.command("run {input.csv} {input[1]} {wildcards.s} {params.p} {config.c} {log} {threads} {resources.mem} > {output} {s} {input}", [("csv", "a.csv"), (None, "b.csv")], [("o", "o.txt")], {"s": "S"}, {"p": "P"}, {"c": "C"}, {"cpu": "4", "mem": "1G"}, "x.log")
    assert text == "run a.csv b.csv S P C x.log 4 1G > o.txt S a.csv b.csv"
    assert patterns.config_substituted("{config.a}/{config.b}", {"a": "x"}, strict=False) == "x/{config.b}"
    with pytest.raises(patterns.PatternError):
        patterns.config_substituted("{config.b}", {})
    assert patterns.normal_path("/r/a/../b/./c", "/r") == "b/c" and patterns.normal_path("../x") == "../x"


GUARD = st.recursive(
    st.one_of(
        st.builds(lambda f, v: {"op": "in", "field": f, "values": v}, NAME, st.lists(VALUE, max_size=3)),
        st.builds(lambda f, v: {"op": "not_in", "field": f, "values": v}, NAME, st.lists(VALUE, max_size=3)),
        st.builds(lambda o, f, v: {"op": o, "field": f, "value": v}, st.sampled_from(["eq", "not_eq"]), NAME, VALUE),
        st.builds(lambda f, p: {"op": "regex", "field": f, "pattern": p}, NAME, st.sampled_from(["a", "^b", "[", "c$"])),
        st.just({"op": "in", "field": "a", "values": "@none"}),
    ),
    lambda g: st.one_of(st.builds(lambda o, gs: {"op": o, "guards": gs}, st.sampled_from(["and", "or"]), st.lists(g, max_size=3)), st.builds(lambda x: {"op": "not", "guard": x}, g)),
    max_leaves=5,
)


@settings(max_examples=25, deadline=None)
@given(st.lists(GUARD, min_size=1, max_size=4), st.lists(st.dictionaries(st.sampled_from("ab"), st.sampled_from(["a", "b", "bc"]), max_size=2), min_size=1, max_size=4))
def test_guards_as_columns_and_on_the_driver(spark, each, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w map<string,string>")
    got = df.select("i", *[guards.as_column(g, F.col("w")).alias(f"g{k}") for k, g in enumerate(each)]).orderBy("i").collect()
    for r, w in zip(got, rows, strict=True):
        assert [r[f"g{k}"] for k in range(len(each))] == [guards.holds(g, w) for g in each]


def test_bad_guards():
    for bad in ("x in y", {"op": "greater"}, {"op": "and", "guards": ["no"]}, {}):
        with pytest.raises(guards.GuardError):
            guards.check(bad)


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_sizes_and_durations(spark):
    assert [None if x is None else int(x) for x in column(spark, ["16G", " 512m ", "1T", "1024", "hello", "", None, "-1", "1.5G", "99999999999999999999", "18446744073709551615K", "7 K"], parsing.byte_size)] == [16 * 10**9, 512 * 10**6, 10**12, 1024, None, None, None, None, None, None, 2**64 - 1, 7000]
    assert [None if x is None else int(x) for x in column(spark, ["4", "-3", "2.5", "-0.5", "3K", "x"], parsing.resource_number)] == [4, 0, 3, 0, 3000, None]
    assert [int(x) for x in column(spark, ["0", "512M", "1GiB", "2kb", "5"], parsing.human_size)] == [0, 512 << 20, 1 << 30, 2048, 5]
    with pytest.raises(Exception, match="invalid size"):
        column(spark, ["1X"], parsing.human_size)
    assert column(spark, ["30s", "2m", "3h", "1d", "45", "x", "", "1.5h"], parsing.duration_seconds) == [30, 120, 10800, 86400, 45, None, None, None]


def test_formats(spark):
    ms = spark.createDataFrame([(i, v) for i, v in enumerate([0, 49, 50, 949, 950, 1000, 59_999, 60_000, 3_599_000, 3_600_000, 90_061_000])], "i int, x long").orderBy("i")
    assert [r[0] for r in ms.select(parsing.format_duration(F.col("x"))).collect()] == ["<0.1s", "<0.1s", "0.1s", "0.9s", "1s", "1s", "59s", "1m00s", "59m59s", "1h00m", "25h01m"]
    assert [r[0] for r in ms.select(parsing.format_span(F.col("x"))).collect()] == ["0ms", "49ms", "50ms", "949ms", "950ms", "1s", "59s", "1m0s", "59m59s", "1h0m", "25h1m"]
    assert column(spark, ["a\n  last \n\n", "\n \n", "", None, "one"], parsing.last_line) == ["last", None, None, None, "one"]
    assert [parsing.kwarg_literal(x) for x in ("1", "2.5", "true", "a b")] == ["1", "2.5", "True", "'a b'"]
    assert re.fullmatch(r"\d{4}-.*Z", column(spark, ["x"], lambda _: parsing.iso8601(F.lit(0)))[0])
