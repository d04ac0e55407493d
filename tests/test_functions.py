import json

import pytest
from forumlens.functions import analysis as A
from forumlens.functions import text as X
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).cast("string" if v is None or isinstance(v, str) else "long").alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


T0 = 1402207451  # 2014-06-08 14:04:11 in UTC+8


@pytest.mark.parametrize(
    "text,want",
    [("Sun Jun  8 14:04:11 2014", T0), ("Sun Jun 8 14:04:11 2014", T0), ("Xyz Jun 08 14:04:11 2014", T0), ("Sun Foo 8 14:04:11 2014", None), ("no", None), (None, None)],
)
def test_posted_at(spark, text, want):
    assert one(spark, X.posted_at(F.col("a")), a=text) == want


def test_times(spark):
    assert one(spark, X.list_date(F.col("a")), a=T0) == " 6/8"
    assert one(spark, X.list_date(F.col("a")), a=None) in ("", None)
    assert one(spark, X.article_time(F.col("a")), a=T0) == "Sun Jun  8 14:04:11 2014"
    for age, want in ((5, "剛剛"), (61, "1 分鐘前"), (7300, "2 小時前"), (90000, "昨天"), (200000, "2 天前"), (700000, "05/31")):
        assert one(spark, X.relative_time(F.lit(T0 - age), T0 + 0), a=1) == want


@pytest.mark.parametrize(
    "raw,want", [(None, ""), ("", ""), ("爆", "c-f1"), ("X3", "c-f1"), ("9", "c-f2"), ("10", "c-f3"), ("99", "c-f3"), ("0", ""), ("-4", ""), ("abc", "")]
)
def test_nrec_class(spark, raw, want):
    assert one(spark, X.nrec_class(F.col("a")), a=raw) == want


def test_links(spark):
    got = one(spark, X.article_url_parts(F.col("a")), a="https://x/bbs/Go/M.1402207451.A.1F2.html")
    assert tuple(got) == ("Go", "M.1402207451.A.1F2", 1402207451)
    assert one(spark, X.article_url_parts(F.col("a")), a="/bbs/Go/index.html") is None
    assert one(spark, X.url_id_time(F.col("a")), a="G.1.A") is None
    assert one(spark, X.index_url(F.lit("B"), F.lit(0)), a=1) == "/bbs/B/index.html"
    assert one(spark, X.index_url(F.lit("B"), F.lit(3)), a=1) == "/bbs/B/index3.html"
    assert [X.index_slug_page(s) for s in ("index7.html", "index.html", "index0.html", "indexx.html", "x7.html")] == [7, None, None, None, None]
    assert [X.page_number("index2.html", 2), X.page_number("index1.html", 2), X.page_number("index3.html", 2)] == [1, 2, None]
    assert one(spark, X.html_escape(F.col("a")), a="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


def test_json_of_any_shape(spark):
    assert one(spark, X.parse_tags(F.col("a")), a='["a", 1, null, "b", {}]') == ["a", "b"]
    for bad in ("{", "7", '{"a": 1}', None):
        assert one(spark, X.parse_tags(F.col("a")), a=bad) == []
    got = one(spark, X.parse_entities(F.col("a")), a='[{"name": "x", "type": "人"}, {"name": 3}, null, "s", {"name": "y"}]')
    assert [tuple(e) for e in got] == [("x", "人"), ("y", "其他")]
    assert tuple(one(spark, X.parse_stance(F.col("a")), a='{"pro": 3, "con": "x"}')) == (3.0, 0.0, 0.0)
    assert one(spark, X.parse_stance(F.col("a")), a="nope") is None


def test_entity_names(spark):
    assert one(spark, X.norm_entity(F.col("a")), a=" ＦＧＯ　 x ") == "fgox"
    assert X.like_literal("%_A_Board\\") == "aboard"
    assert one(spark, X.excerpt(F.col("a")), a="  a　\n b c ") == "a b c"


@given(st.text(max_size=30))
def test_norm_is_stable(text):
    once = X.norm_query(text)
    assert "".join(once.split()) == once


def test_analysis_of_any_answer():
    raw = '```json\n{"tldr": " hi ", "sentiment": "很正面", "controversy": "中高", "tags": ["a", 1], "article_type": "新聞/問卦", "ad_likelihood": "高度疑似",'
    raw += '"entities": [{"name": " N ", "type": 5}, {"name": ""}, null, 3], "push_stance": {"pro": 150, "con": -5, "neutral": "x"}, "ai_generated": "疑似"}\n```'
    got = A.parse_analysis(raw)
    assert (got["tldr"], got["sentiment"], got["controversy"], got["article_type"]) == ("hi", "正面", "高", "新聞")
    assert (got["ad_likelihood"], got["ai_generated"], got["factuality"]) == ("高度", "疑似AI", "觀點")
    assert json.loads(got["entities"]) == [{"name": "N", "type": "5"}]
    assert json.loads(got["push_stance"]) == {"pro": 100, "con": 0, "neutral": 0}
    assert len(A.entities([{"name": f"n{i}"} for i in range(12)])) == 8
    for bad in ("", "{}", '{"tldr": " "}', '{"tldr": 3}', "[1]", "not json"):
        with pytest.raises(ValueError):
            A.parse_analysis(bad)


@given(st.one_of(st.none(), st.integers(), st.floats(), st.text(), st.booleans(), st.lists(st.integers())))
def test_stance_is_always_a_share(value):
    got = json.loads(A.parse_analysis(json.dumps({"tldr": "x", "push_stance": {"pro": value}}))["push_stance"])
    assert 0 <= got["pro"] <= 100


def test_prompt(spark):
    pushes = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit("推").alias("tag"), F.lit("u").alias("user_id"), F.lit(f"c{i}").alias("content")) for i in range(2)))
    got = one(spark, A.prompt(F.col("t"), F.col("a"), F.col("c"), pushes), t="T", a="me", c="x" * 3001)
    lines = got.split("\n")
    assert lines[0] == "標題：T" and lines[1] == "作者：me" and "...(內容過長已截斷)" in got
    assert got.endswith("--- 推文（共 2 則）---\n推 u: c0\n推 u: c1")
    many = F.transform(F.sequence(F.lit(1), F.lit(501)), lambda i: F.struct(i.alias("seq"), F.lit("→").alias("tag"), F.lit("u").alias("user_id"), F.lit(None).cast("string").alias("content")))
    got = one(spark, A.prompt(F.col("t"), F.col("a"), F.col("c"), many), t="", a=None, c=None)
    assert got.startswith("標題：(無標題)\n\n---") and "共 501 則，僅顯示前 500 則" in got and got.count("→ u: ") == 500


def test_settings():
    from forumlens import settings as S

    env = {"a": "5m", "b": "90s", "c": "250ms", "d": "1.5h", "e": "7", "f": "x", "g": "", "h": "inf", "i": "3.5"}
    assert [S.seconds(env, k, 1) for k in "abcdefgz"] == [300, 90, 0.25, 5400, 7, 1, 1, 1]
    assert [S.number(env, k, 2.0) for k in "efhiz"] == [7, 2, 2, 3.5, 2]
    assert [S.whole(env, k, 2) for k in "efiz"] == [7, 2, 2, 2] and S.whole(env, "e", 2, 8) == 2
    assert S.text(env, "g", "d") == "d" and S.text(env, "f", "d") == "x"
