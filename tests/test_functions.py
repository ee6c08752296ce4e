"""Functions against plain Python on handcrafted rows, and properties."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import reward as R
from millrace.functions import text as T

TEXTS = [None, "", "   ", "Hello, World!", "Ünïcode  CAFÉ", "编辑 图片abc", "a-b_c", "\t\xa0x", "İK", "x" * 50_000]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def normalize(s):
    return None if s is None else re.sub(r"\s+", " ", re.sub("[^a-z0-9一-鿿]+", " ", s.lower())).strip()


def test_normalize(spark):
    assert run(spark, TEXTS, T.normalize) == [normalize(s) for s in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda s: "\ud800" > max(s or " ") or min(s) > "\udfff"), max_size=40))
def test_normalize_any(spark, texts):
    keep = [t for t in texts if t.isascii() or all(len(c.lower()) == 1 for c in t)]
    assert run(spark, keep, T.normalize) == [normalize(t) for t in keep]


def test_grams(spark):
    values = ["a b c d e f", "a b", "", "a a a a a a"]
    got = run(spark, values, lambda c: T.gram_set(T.words(T.normalize(c))))
    assert [set(g) for g in got] == [{"a b c d e", "b c d e f"}, {"a b"}, set(), {"a a a a a"}]
    assert all(len(g) == len(set(g)) for g in got)


def test_jaccard_is_symmetric_and_zero_for_empty(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    rows = df.select(T.jaccard(F.col("a"), F.col("b")), T.jaccard(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(1 / 3, 1 / 3), (0.0, 0.0), (0.0, 0.0)]


def test_slug_cuts_after_trimming(spark):
    assert run(spark, ["__A b!c__", "", "!!!", "x" * 100, None], T.slug) == ["a_b_c", "item", "item", "x" * 80, None]


def test_hamming(spark):
    df = spark.createDataFrame([("0" * 16, "f" * 16), ("00000000000000ff", "000000000000000f"), (None, "0" * 16), ("xyz", "0" * 16)], "a string, b string")
    assert [r[0] for r in df.select(T.hamming(F.col("a"), F.col("b"))).collect()] == [64, 4, None, None]


def test_answers(spark):
    df = spark.createDataFrame([("A -> B", "a, b"), ("red", "It is red."), ("4", "5"), (None, None), ("x and y", "x y"), ("", "z")], "e string, g string")
    assert [r[0] for r in df.select(T.same_answer(F.col("e"), F.col("g"))).collect()] == [True, True, False, True, True, False]


def test_json_object(spark):
    values = ['```json\n{"a": 1}\n```', 'So: {"a": {"b": 2}} done', "none", None]
    assert run(spark, values, T.json_object) == ['{"a":1}', '{"a":{"b":2}}', None, None]


def test_wrap_and_score(spark):
    assert run(spark, ["aa bb cc", "", "longword x"], lambda c: T.wrap(c, 5)) == [["aa bb", "cc"], [], ["longword", "x"]]
    assert run(spark, ["1.5", "x", None], T.score) == [1.5, None, None]


def test_contains_any_takes_terms_as_they_stand(spark):
    assert run(spark, ["a [v b", "firefly", None, ""], lambda c: T.contains_any(c, ["[v", "fire"])) == [True, True, False, False]
    assert run(spark, ["gun fire", None], lambda c: T.terms_in(c, ["fire", "gun", "bomb"])) == [["fire", "gun"], []]


def fuse(h):
    c = lambda x: max(0.0, min(1.0, x))
    gate = min(c(h.get("execution", 0)), c(h.get("cognitive", 1)))
    q = c(h.get("quality", 0))
    image = gate * (0.45 + 0.2 * c(h.get("preservation", 0)) + 0.15 * c(h.get("region", 0)) + 0.1 * q + 0.1 * c(h.get("readability", q)))
    return c(0.45 * c(h.get("program", 0)) + 0.45 * image + 0.05 * c(h.get("tool", 0)) + 0.05 * c(h.get("format", 0)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["execution", "cognitive", "preservation", "region", "quality", "readability", "program", "tool", "format"]), st.floats(-0.5, 1.5)), min_size=1, max_size=20))
def test_fused_rewards(spark, items):
    names = ["execution", "cognitive", "preservation", "region", "quality", "readability", "program", "tool", "format"]
    df = spark.createDataFrame([(i, *(h.get(n) for n in names)) for i, h in enumerate(items)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = [r[0] for r in df.orderBy("i").select(R.fuse({n: F.col(n) for n in names})).collect()]
    assert all(0 <= g <= 1 for g in got)
    assert all(abs(g - fuse(h)) < 1e-9 for g, h in zip(got, items, strict=True))


def test_review_ignores_null_scores(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None), ([" Wrong_Edit"], 5.0, 5.0, 5.0, 0.0, 5.0, 5.0), (None, 5.0, 5.0, 3.0, 0.0, 5.0, 5.0), (None, 2.0, 5.0, 5.0, 0.0, 5.0, 5.0), (None, 5.0, 5.0, 5.0, 0.0, 5.0, 5.0)], "f array<string>, a double, b double, c double, d double, e double, g double")
    assert [r[0] for r in df.select(R.review(*(F.col(c) for c in "fabcdeg"))).collect()] == ["accept", "reject", "review", "reject", "accept"]


def test_program_and_item_heads(spark):
    df = spark.createDataFrame([(True, 0, 0, ["analyze_image", "search"], "x_teacher.png", "0" * 16, "f" * 16), (False, 3, 2, [], "x_negative.png", None, None)], "ok boolean, e int, w int, t array<string>, p string, a string, b string")
    yes = F.lit(True)
    h = R.program_heads(F.col("ok"), F.col("e"), F.col("w"), [yes, yes, yes, F.lit(False), yes, yes], yes, F.col("t"))
    rows = df.select(*(h[k].alias(k) for k in h)).collect()
    assert [round(rows[0][k], 4) for k in ("program", "format", "tool")] == [0.9133, 1.0, 1.0]
    assert [round(rows[1][k], 4) for k in ("program", "format", "tool")] == [0.9133, 0.2, 0.5]
    i = R.item_heads(h, R.change(F.col("a"), F.col("b")), F.col("p"), F.lit(None).cast("string"))
    rows = df.select(*(i[k].alias(k) for k in i), R.failure(i).alias("f")).collect()
    assert rows[0]["execution"] == 0.95 and rows[0]["preservation"] == 0.9 and rows[0]["f"] == "none"
    assert rows[1]["cognitive"] == 0.25 and rows[1]["region"] == 0.25 and rows[1]["f"] == "format_fail"
