import datetime as dt
import hashlib
import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import canon, kleene
from recordloom.functions import text as tx


def one(spark, column, **values):
    types = {str: "string", int: "long", list: "array<string>", bool: "boolean", bytes: "binary"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_kleene_groups_agree_with_rows(spark):
    truths = [True, False, None]
    rows = [(f"{i}{j}", t) for i, a in enumerate(truths) for j, b in enumerate(truths) for t in (a, b)]
    found = spark.createDataFrame(rows, "g string, t boolean").groupBy("g").agg(kleene.truth(kleene.all_of(kleene.level(F.col("t")))).alias("a"), kleene.truth(kleene.any_of(kleene.level(F.col("t")))).alias("o")).collect()
    pairs = spark.createDataFrame([(f"{i}{j}", a, b) for (i, a), (j, b) in itertools.product(enumerate(truths), repeat=2)], "g string, a boolean, b boolean")
    want = {r.g: (r.x, r.y) for r in pairs.select("g", (F.col("a") & F.col("b")).alias("x"), (F.col("a") | F.col("b")).alias("y")).collect()}
    assert {r.g: (r.a, r.o) for r in found} == want


def test_kleene_of_nothing(spark):
    none = spark.createDataFrame([], "t boolean")
    row = none.agg(kleene.all_of(kleene.level(F.col("t"))).alias("a"), kleene.any_of(kleene.level(F.col("t"))).alias("o"), kleene.all_of(kleene.level(F.col("t")), kleene.UNKNOWN).alias("u")).first()
    assert tuple(row) == (2, 0, 1)
    assert one(spark, kleene.array_all(F.array().cast("array<int>")), v="") == 2


def test_stable_text_and_locations(spark):
    assert one(spark, tx.stable_text(F.col("v")), v=" ＡＢ（１）：　x  y\n") == "AB(1): x y"
    assert one(spark, tx.location_name(F.col("v")), v="北 京　市") == "北京" and one(spark, tx.location_name(F.col("v")), v="苏州") == "苏州"
    assert one(spark, tx.stable_text(F.col("v")), v="𠮷 a") == "𠮷 a"


@pytest.mark.parametrize("text,date,year", [("2026-2-31", "2026-02-31", 2026), ("至2026年3月4日止", "2026-03-04", 2026), ("12026-1-1", None, None), ("no", None, None), ("x2027.10.09", "2027-10-09", 2027)])
def test_dates(spark, text, date, year):
    assert one(spark, tx.iso_date(F.col("v")), v=text) == date and one(spark, tx.year_of(F.col("v")), v=text) == year


def test_labelled_date(spark):
    f = tx.deadline(F.col("v"))
    assert one(spark, tx.start_date(F.col("v")), v="发布日期：2026.1.2，截止2026-05-06") == "2026-01-02"
    assert [one(spark, tx.education(F.col("v")), v=v) for v in ("博士优先", "硕士", "本科", "x")] == ["硕士及以上", "硕士研究生", "本科及以上", "学历要求待核验"]
    assert one(spark, f, v="发布 2026-01-01；截止：2026年5月6日") == "2026-05-06"
    assert one(spark, f, v="截止：待定。2026-05-06") is None


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://A.com//x//y/?b=2&a=1#f", "http://a.com/x/y?a=1&b=2"),
        ("https://a.com", "https://a.com/"),
        ("ftp://a.com/x", None),
        ("https://u@a.com/x", None),
        (None, None),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, tx.url_canonical(F.col("v")), v=url) == want


def test_url_predicates(spark):
    urls = {"https://a.com/jobs": (True, False), "https://a.com/jobs/1": (True, True), "https://a.com/x?jobId=4": (True, True), "http://a.com/job-12.html": (False, True), "https://192.168.0.1/job/2": (False, True), "https://a.com/list.html#x": (False, False)}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tx.safe_url(F.col("u")).alias("s"), tx.detail_url(F.col("u")).alias("d")).collect()
    assert {r.u: (r.s, r.d) for r in rows} == urls


def test_html_text(spark):
    html = "<html><style>p{}</style><script>var t='</p>';</script><p>a&nbsp;&amp;lt; b<br>c</p><!-- x --><div> d </div></html>"
    assert one(spark, tx.html_text(F.col("v")), v=html) == "a &lt; b\nc\nd"


def test_charsets(spark):
    assert one(spark, tx.decoded(F.col("v"), F.lit("GBK")), v="法学".encode("gbk")) == "法学"
    assert one(spark, tx.decoded(F.col("v"), F.lit(None).cast("string")), v="法学".encode()) == "法学"
    assert one(spark, tx.decoded(F.col("v"), F.lit("utf-8")), v=b"\xff\xfe") is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ;；。\n", max_size=12), min_size=1, max_size=6))
def test_clauses_lead_back(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", tx.clauses(F.col("t")).alias("c")).collect()
    for r in rows:
        import re

        assert [c.text for c in r.c] == [x.strip() for x in re.split("[;；。\n]+", r.t) if x.strip()]
        assert all(r.t[c.start : c.end] == c.text and c.place == k for k, c in enumerate(r.c, 1))


def test_lists(spark):
    assert one(spark, tx.unmarked(F.col("v")), v="（2）本科") == "本科" and one(spark, tx.unmarked(F.col("v")), v="一、x") == "x"
    assert one(spark, tx.split_outside(F.col("v"), ("法律（法学、非法学）",)), v="a(b,c)、d，法律（法学、非法学）/e") == ["a(b,c)", "d", "法律（法学、非法学）", "e"]
    assert one(spark, tx.cities_in(F.col("v")), v="上海、北京和杭州，还有深圳与广州") == "北京、上海、深圳、广州"
    assert one(spark, tx.cities_in(F.col("v")), v="x") == "全国/未注明"
    assert one(spark, tx.mail_link(F.col("v")), v="to A.b@c.org!") == "mailto:A.b@c.org"


def test_ages_and_times(spark):
    d = lambda s: F.lit(s).cast("date")
    assert [one(spark, tx.full_years(d(a), d(b)), v="") for a, b in [("2000-02-29", "2023-02-28"), ("2000-02-29", "2023-03-01"), ("2000-05-05", "2020-05-05")]] == [22, 23, 20]
    assert one(spark, tx.local_date(F.lit("2026-01-01 17:00:00").cast("timestamp")), v="") == dt.date(2026, 1, 2)
    assert [one(spark, tx.clamped(F.lit(n)), v="") for n in (-3, 3, 9)] == [1, 3, 5]
    assert one(spark, tx.next_run(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit(60), F.lit(90)).cast("string"), v="") == "2026-01-01 00:01:30"


def test_redaction_and_csv(spark):
    assert one(spark, F.map_keys(tx.redacted(F.create_map(F.lit("Accept"), F.lit("1"), F.lit("X-API-Key"), F.lit("2"), F.lit("Set-Cookie"), F.lit("3")))), v="") == ["Accept"]
    assert [one(spark, tx.csv_cell(F.col("v")), v=v) for v in ('a"b', "=1", None)] == ['"a""b"', '"\'=1"', '""']


def test_canonical_forms(spark):
    fields = {"b": F.lit(1), "a": F.array(F.lit("y"), F.lit("x"), F.lit("y")), "c": F.lit(None).cast("string")}
    text = one(spark, canon.canonical_json(fields), v="")
    assert list(json.loads(text)) == ["a", "b", "c"] and text.endswith('"c":null}')
    assert "c" not in json.loads(one(spark, canon.canonical_json(fields, keep_nulls=False), v=""))
    other = {**fields, "a": F.array(F.lit("x"), F.lit("y"))}
    assert one(spark, canon.semantic_hash(fields, sets=("a",)), v="") == one(spark, canon.semantic_hash(other, sets=("a",)), v="")
    assert one(spark, canon.semantic_hash(fields), v="") != one(spark, canon.semantic_hash(other), v="")
    assert one(spark, canon.same_set(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1), F.lit(1))), v="")


def test_identity_bases_depend_on_their_order(spark):
    choices = [("id", {"id": F.lit("7")}), ("url", {"url": F.lit("/u")})]
    assert one(spark, canon.first_basis(*choices)["kind"], v="") == "id" and one(spark, canon.first_basis(*choices[::-1])["kind"], v="") == "url"
    assert one(spark, canon.identity_hash(F.lit("s"), canon.first_basis(("id", {"id": F.lit(None).cast("string")}))), v="") is None


def test_semantic_hash_query_keeps_one_of_each_value(spark, tmp_path):
    from recordloom.plans import texts

    spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, "a")], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    out = texts.q_semantic_hash(spark, str(tmp_path))
    assert {r.o_custkey: r.content_hash for r in out.collect()} == {
        k: hashlib.sha256(('{"keys":[' + v + f'],"owner":{k},"spare":null}}').encode()).hexdigest() for k, v in [(1, '"a","b"'), (2, '"a"')]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "collect_list" not in plan
