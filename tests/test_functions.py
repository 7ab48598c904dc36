"""Functions against known cases."""

import datetime as dt

import pytest
from eventloom.functions import text, time, values, vectors
from pyspark.sql import functions as F

STAGES = ["需求分析", "设计", "开发", "测试", "上线"]
CASES = [
    ("20230117", "time", None, None, None, "datetime", dt.datetime(2023, 1, 17)),
    ("20230117", None, None, None, None, "int", 20230117),
    ("20231332", "time", None, None, None, "int", 20231332),
    ("20240229", "time", None, None, None, "datetime", dt.datetime(2024, 2, 29)),
    ("20230229", "time", None, None, None, "int", 20230229),
    ("20230117143025", "time", None, None, None, "datetime", dt.datetime(2023, 1, 17, 14, 30, 25)),
    ("202301171430", "time", None, None, None, "datetime", dt.datetime(2023, 1, 17, 14, 30)),
    ("202301", "time", None, None, None, "datetime", dt.datetime(2023, 1, 1)),
    ("2023年1月17日", "time", None, None, None, "datetime", dt.datetime(2023, 1, 17)),
    ("2025年11月28日 05:52:25", None, None, None, None, "datetime", dt.datetime(2025, 11, 28, 5, 52, 25)),
    ("2024", None, None, None, None, "datetime", dt.datetime(2024, 1, 1)),
    ("2024元", None, None, None, None, "int", 2024),
    ("1234", None, None, None, None, "int", 1234),
    ("123", None, "int", None, None, "int", 123),
    ("123.45", None, "int", None, None, None, None),
    ("1e5", None, "int", None, None, None, None),
    ("123", None, "float", None, None, "float", 123.0),
    ("abc", None, "float", None, None, None, None),
    ("七个订单", None, "int", "订单", None, "int", 7),
    ("七个订单", None, "int", "项目", None, None, None),
    ("3.5个", None, "float", "个", None, "float", 3.5),
    ("正在开发中", None, "enum", None, STAGES, "enum", "开发"),
    ("维护阶段", None, "enum", None, STAGES, "enum", "UNKNOWN"),
    ("设计", None, None, None, STAGES, "enum", "设计"),
    ("三千万", None, None, None, None, "int", 30000000),
    ("五十", None, None, None, None, "int", 50),
    ("十", None, None, None, None, "text", None),
    ("一二三四五六七八", None, None, None, None, "text", None),
    ("199元", None, None, None, None, "int", 199),
    ("3.5亿美元", None, None, None, None, "float", 3.5),
    ("3.5亿", None, None, None, None, "int", 350000000),
    ("50g", None, None, None, None, "float", 0.05),
    ("1.5e3", None, None, None, None, "int", 1500),
    ("1,234.5", None, None, None, None, "float", 1234.5),
    ("yes", None, None, None, None, "bool", True),
    ("关闭", None, None, None, None, "bool", False),
    ("是的", None, None, None, None, "text", None),
    ("  ", None, None, None, None, None, None),
    (None, None, None, None, None, None, None),
]


def test_value_parser(spark):
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(CASES)], "k int, t string, category string, kind string, unit string, vals array<string>")
    got = df.select("k", values.parse_value(F.col("t"), F.col("category"), kind=F.col("kind"), unit=F.col("unit"), enum_values=F.col("vals")).alias("v")).collect()
    for r in got:
        want = CASES[r.k]
        assert (r.v and r.v.type) == want[5], (want, r.v)
        if want[6] is not None:
            assert r.v[f"{want[5]}_value"] == want[6], (want, r.v)


TEXT = [
    (text.normalize_text, " a 　 b\n", "a b"),
    (text.normalize_entity_name, " A-b,  C! ", "ab c"),
    (text.normalize_entity_name_keep_gaps, "a - b", "a  b"),
    (text.name_key, "A B　c", "abc"),
    (text.markdown_headings, "# A\nx\n  ### B c", ["# A", "### B c"]),
    (text.truncate, "x" * 120, "x" * 97 + "..."),
    (text.paragraphs, "a\n\n b \n\n\n\n", ["a", "b"]),
    (text.count_chinese, "a中文b", 2),
    (text.estimate_tokens, "中文abcdefgh", 3),
    (text.chunk_tokens, "hello world, 中文", 3),
    (text.chunk_tokens, "", 0),
    (text.clean_whitespace, "a   b \n\n\n\n c", "a b\n\nc"),
    (text.sentences, "First one. really! ok? 这是第一句。短。", ["First one. really", "这是第一句"]),
    (text.detect_language, "中文字 abcde", "chinese"),
    (text.normalize_answer, "The cat, an  Apple!", "cat apple"),
    (text.purify, "A-b c.\n", "abc"),
    (text.split_keeping, "a.b!c", ["a.", "b!", "c"]),
    (text.tokens, "Abc 中文 d_1", ["abc", "中", "文", "d_1"]),
    (text.word_count, "two words", 2),
]


@pytest.mark.parametrize(("f", "x", "want"), TEXT)
def test_text(spark, f, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_text_pairs(spark):
    df = spark.createDataFrame([("This is one. 第一句话。last part here", "is")], "t string, n string")
    r = df.select(text.sentences_with_ends(F.col("t")).alias("s"), text.count_occurrences(F.col("t"), F.col("n")).alias("n"), text.count_occurrences(F.col("t"), F.lit("")).alias("z"), text.count_occurrences(F.col("t"), F.lit("zz"), least=1).alias("o")).first()
    assert [tuple(x) for x in r.s] == [("This is one. 第一句话", "。"), ("last part here", "")] and (r.n, r.z, r.o) == (2, 0, 1)
    bad = spark.createDataFrame([("t", "http://a.b/c", 1), ("", "x", 1), ("t", "扫码 微信: abc", 1), ("t", "fine content here", 1), ("t", "a\x01\x02\x03b longer text", 2)], "a string, b string, c int")
    assert [r[0].reason for r in bad.select(text.low_quality(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["only links", "empty", "advertisement", None, "control characters"]


def test_time(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("2024-02-29 23:59:30",), ("2024-02-29 23:00:00",), ("2024-02-29 01:00:00",), ("2024-02-01 00:00:00",), ("2023-03-03 00:00:00",), ("2021-01-01 00:00:00",)], "t string")
    got = [r[0] for r in df.select(time.time_ago(F.col("t").cast("timestamp_ntz"), now)).collect()]
    assert got == ["刚刚", "1小时前", "23小时前", "29天前", "12个月前", "3年前"]
    r = df.select(time.parse_iso(F.lit("2024-01-02T03:04:05Z")).alias("a"), time.parse_iso(F.lit("no")).alias("b"), time.time_decay(F.lit("2024-02-20").cast("timestamp_ntz"), now).alias("d")).first()
    assert r.a is not None and r.b is None and abs(r.d - 0.904837) < 1e-6


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([-1.0, 0.0], [1.0, 0.0]), ([float("nan")], [1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.cosine(a, b).alias("c"), vectors.cosine(a, b, clip=True).alias("k"), vectors.cosine(a, b, guard=False).alias("r"), vectors.is_valid(a).alias("v")).collect()
    assert abs(got[0].c - 0.70710678) < 1e-8 and got[1].c == 0 and got[1].r is None and got[2].k == 0 and [g.v for g in got] == [True, True, True, False]
