"""Assembled records, reports and puzzles: nulls, empty tables, ties and repeated rows, clashing columns."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import reward as R
from millrace.functions import text as T
from millrace.operators import assemble, decontam, gates, sampling, solvers, summaries, validate
from millrace.plans import catalog, records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_accepted_tasks(spark):
    tasks = spark.createDataFrame([("a", "x.png", "do"), ("b", "x.png", "do"), ("c", "lost.png", "do"), ("d", None, None)], "task_id string, source_image string, instruction string")
    labels = spark.createDataFrame([("a", True), ("b", None), ("c", True), ("d", True)], "task_id string, accept_sft boolean")
    tr = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "task_id string, trajectory string")
    note = "struct<target_scene_description:string,analysis:string,edit_operations:array<string>,editor_prompt:string>"
    ann = spark.createDataFrame([("a", ("s", "x", ["o"], "p")), ("c", ("s", "", ["o"], "p"))], f"task_id string, annotation {note}")
    images = spark.createDataFrame([("x.png",), ("x.png",), (None,)], "path string")
    assert [r["task_id"] for r in assemble.accepted(tasks, labels, tr, ann, images, require=True).collect()] == ["a"]
    assert {r["task_id"] for r in assemble.accepted(tasks, labels, tr).collect()} == {"a", "c"}
    assert assemble.accepted(tasks.limit(0), labels, tr, ann, images).count() == 0


def test_filled_and_last(spark):
    df = spark.createDataFrame([("a", 1, None, []), ("a", 2, "", ["x"]), ("b", 1, "t", None)], "task_id string, seq int, s string, l array<string>")
    assert [tuple(r) for r in df.select(assemble.filled(F.col("s")), assemble.filled(F.col("l"))).collect()] == [(False, False), (False, True), (True, False)]
    assert rows(assemble.last(df, "seq").select("task_id", "seq")) == [("a", 2), ("b", 1)]


def test_sft_export_of_empty_texts(spark, tmp_path):
    """Empty instructions, marks within texts and missing times of arrival are exported as by the SQL."""
    cols = "task_id string, source_image string, instruction string, expected_target string, render_status string, sub_family string, license string, split string, ingested_at timestamp, leakage_tags struct<benchmark_text_exact_match:boolean>"
    at, later, tags = datetime(2026, 1, 1), datetime(2026, 1, 2), (False,)
    told = [("a", "do", "t", at), ("b", "", "t", at), ("c", " ", " ", at), ("d", None, "t", at), ("e", "do", "", at), ("f", "do", "x\n\n<edit_program>\ny", at), ("g", "", "t", None), ("h", "new", "t", later), ("h", "old", "t", at), ("h", "none", "t", None)]
    seeds = [(k, "x.png", i, t, "ok", None, None, None, when, tags) for k, i, t, when in told] + [("i", "x.png", "do", "t", "ok", None, None, None, at, (True,)), ("j", "lost.png", "", "t", "ok", None, None, None, at, tags)]
    spark.createDataFrame(seeds, cols).write.parquet(f"{tmp_path}/{records.SEEDS}.parquet")
    spark.createDataFrame([(("x.png",),)], "image struct<path:string>").write.parquet(f"{tmp_path}/{records.POOL}.parquet")
    con = duckdb.connect()
    for t in (records.SEEDS, records.POOL):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = rows(catalog.queries()["sft_export"](spark, str(tmp_path)).select("task_id", "human", "analysis"))
    assert got == sorted(con.execute(f"select task_id, human, analysis from ({catalog.oracle_sql()['sft_export']})").fetchall())
    assert [r[0] for r in got] == ["a", "b", "c", "f", "g", "h"]


def test_rewritten_messages(spark):
    kind = "array<struct<role:string,content:array<struct<type:string,path:string,text:string>>>>"
    text, image = lambda t: ("text", None, t), ("image", "a.png", None)
    old = [[("user", [image, text("old"), text("older")]), ("assistant", [text("x")]), ("tool", [text("kept")]), ("user", [text("second")])], [("assistant", [text("x")])], []]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(old)], f"i int, m {kind}").orderBy("i")
    got = [[(m["role"], [p["text"] for p in m["content"]]) for m in r[0]] for r in df.select(assemble.rewritten_messages(F.col("m"), F.lit("new"), F.lit("why"))).collect()]
    assert got == [[("user", [None, "new", "new"]), ("tool", ["kept"]), ("user", ["second"]), ("assistant", ["why"])], [("assistant", ["why"])], [("assistant", ["why"])]]


def test_override_and_dimension(spark):
    df = spark.createDataFrame([("a", "own"), ("b", None), ("c", "own")], "k string, v string")
    lookup = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("a", None, 3), ("b", "b", 1)], "k string, v string, at int")
    assert rows(assemble.with_override(df, lookup, "k", "v", "at")) == [("a", "two"), ("b", "b"), ("c", "own")]
    over = assemble.overlaid([df, lookup.select("k", "v").filter("k = 'b'")], "k")
    assert rows(over) == [("a", "own"), ("b", "b"), ("c", "own")]


def test_seeds_from_hits(spark):
    bank = spark.createDataFrame([("q1", "i1"), ("q2", "i2")], "query string, instruction string")
    hits = spark.createDataFrame([("q1", "1", "s1", "n1"), ("q1", "2", "s2", "leak"), ("q2", "0", "s1", "n1"), ("q2", "5", "s3", "n3"), ("q2", "5", "s3", "n3")], "query string, at string, sha256 string, norm string")
    got = rows(assemble.seeds_from_hits(bank, hits, spark.createDataFrame([("leak",)], "norm string"), "t"))
    assert got == [("t000000", "q1", "s1", "i1"), ("t000001", "q2", "s3", "i2")]


def test_dataset_errors(spark):
    tasks = spark.createDataFrame([("a", "x", [0.5, 0.5], False), ("a", "x", [0.5, 0.5], False), ("b", None, [0.5], True), ("c", "y", None, None)], "task_id string, source_image string, weights array<double>, leaked boolean")
    images, child = spark.createDataFrame([("x",)], "path string"), spark.createDataFrame([("a",), (None,), ("z",)], "task_id string")
    renders = spark.createDataFrame([("a", "x"), ("a", None), ("a", "r")], "task_id string, image_path string")
    got = {(r["type"], r["task_id"]) for r in validate.dataset_errors(tasks, ["source_image"], {"programs": child}, images, renders).collect()}
    assert got == {
        ("duplicate_task_ids", "a"), ("missing_task_fields", "b"), ("missing_source_image", "b"), ("missing_source_image", "c"), ("missing_render_images", "a"), ("bad_checklist_weights", "b"), ("bad_checklist_weights", "c"),
        ("exact_benchmark_text_match", "b"), ("unknown_task_id_in_programs", None), ("unknown_task_id_in_programs", "z"),
    }
    assert validate.dataset_errors(tasks.limit(0), ["source_image"], {"programs": child.limit(0)}, images, renders.limit(0)).count() == 0
    assert validate.unknown_values(["a", " ", "b "], ["a", "b"], "names") == ["a", "b"]
    with pytest.raises(ValueError, match="unknown names: c"):
        validate.unknown_values(["c"], ["a"], "names")


def test_issues_of_all_strings(spark):
    items = spark.createDataFrame([(1, "B", "s1", "instruction", "turn the red lamp into a blue one now", None, None), (2, "B", "s2", "text", None, None, None)], "item_id long, benchmark string, sample_id string, field string, text string, normalized_text string, text_hash string")
    df = spark.createDataFrame([("r1", "Turn the red lamp into a blue one, NOW!", None), ("r2", "please turn the red lamp into a blue one now", {"k": [("see data/benchmarks/x.json",)]}), ("r3", None, None)], "row_id string, instruction string, more map<string,array<struct<prompt:string>>>")
    values = decontam.text_values(df, "row_id")
    found = decontam.issues(values, items, df.select("row_id", F.lit('{"official_score": null}').alias("raw")).filter("row_id = 'r3'"), threshold=0.5)
    got = {(r["row_id"], r["type"], r["severity"], r["sample_id"]) for r in found.collect()}
    assert got == {("r1", "exact_benchmark_text", "high", "s1"), ("r2", "ngram_benchmark_text", "medium", "s1"), ("r2", "forbidden_path", "high", None), ("r3", "forbidden_field", "high", None)}
    v = decontam.verdict(found, df, items).first()
    assert (v["rows_checked"], v["benchmark_text_items"], v["high"], v["medium"], v["ok"], v["fails_on_medium"]) == (3, 1, 3, 1, False, True)
    clean = decontam.verdict(found.limit(0), df.limit(0), items.limit(0)).first()
    assert clean["ok"] and not clean["fails_on_high"] and clean["rows_checked"] == 0


def test_hashed_grams_are_the_grams(spark):
    texts = ["a b c d e f", "a b", "x", "a b c d e a b c d e", "", None, "w " * 3000 + "end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("t", T.normalize(F.coalesce("t", F.lit(""))))
    for n in (1, 5, 8):
        one = decontam.grams(df, "i", F.col("t"), n).groupBy("i", "size").agg(F.countDistinct("gram").alias("m"))
        two = decontam.hashed_grams(df, "i", F.col("t"), n).groupBy("i", "size").agg(F.countDistinct("gram").alias("m"))
        assert rows(one) == rows(two)
    both = decontam.hashed_grams(df, "i", F.col("t"), 5).groupBy("gram").agg(F.countDistinct("i").alias("m")).filter("m > 1").count()
    assert both == 1  # a b c d e


def test_group_rank_is_the_rank(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else None if i % 2 else "small") for i in range(600)], "k int, g string")
    got = {r["k"]: r["rn"] for r in sampling.group_rank(df, "k", ["g"]).collect()}
    want = {r["k"]: r["rn"] for r in sampling.rank(df, [sampling.shuffled("k"), F.col("k")], ["g"]).collect()}
    assert got == want and sampling.group_rank(df.limit(0), "k", ["g"]).count() == 0


def test_advantage_of_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0), ("c", None)], "g string, r double")
    got = {(r["g"], r["r"]): r["advantage"] for r in R.with_advantage(df, "g", "r").collect()}
    assert round(got["a", 1.0], 4) == -1.0 and got["b", 5.0] == 0.0 and got[None, 2.0] is None and got["c", None] is None


def test_paths_of_any_length(spark):
    chain = [(1, f"n{i:02d}", f"n{i + 1:02d}", 1) for i in range(20)] + [(2, "n00", "x", 1)]
    edges = spark.createDataFrame(chain, "graph long, a string, b string, w long")
    assert [(r["graph"], len(r["path"]), r["distance"]) for r in solvers.shortest_paths(edges, "n00", "n20").collect()] == [(1, 21, 20)]
    square = spark.createDataFrame([(1, "A", "B", 1), (1, "B", "C", 1), (1, "A", "C", 3), (1, "C", "A", 5)], "graph long, a string, b string, w long")
    paths = solvers.simple_paths(square, "A", "C")
    assert sorted(r["distance"] for r in paths.collect()) == [2, 3, 5] and solvers.longer_path(paths).first()["distance"] == 3
    assert solvers.shortest_paths(edges.limit(0), "a", "b").count() == 0 == solvers.simple_paths(edges.limit(0), "a", "b").count()


def test_puzzles_are_repeatable(spark):
    p = solvers.puzzles(spark, 300)
    assert rows(p.select("puzzle", "answer")) == rows(solvers.puzzles(spark, 300).select("puzzle", "answer"))
    assert p.filter("answer is null").count() == 0 and p.select("solver").distinct().count() == 15
    assert p.withColumn("a", solvers.solve(F.lit("nothing"), F.col("params"))).filter("a is not null").count() == 0


def test_verifier_errors(spark):
    p = solvers.puzzles(spark, 15)
    check = lambda q, e: F.array(F.struct(F.lit(q).alias("question"), F.lit(e).alias("expected_answer")))
    error = lambda name, checks, wrong="no": p.filter(F.col("solver") == name).select(solvers.verifier_error(F.col("solver"), F.col("params"), checks, F.lit(wrong))).first()[0]
    assert error("circuit_bulb", check(solvers.BULB, "yellow")) is None and error("circuit_bulb", check(solvers.BULB, "gray")) == "answer"
    assert error("ph_indicator", check("What?", "red")) == "question"
    arrows = [F.struct(F.lit(f"Is there an arrow pointing from {a} to {b}? Answer yes or no.").alias("question"), F.lit("yes").alias("expected_answer")) for a, b in (("grass", "rabbit"), ("rabbit", "fox"), ("fox", "eagle"))]
    assert error("food_chain", F.array(*arrows)) is None and error("food_chain", F.array(*arrows[:2])) == "answer"
    assert error("sudoku4", check("?", "?")) is None


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.csv_set(F.lit(" b, a,,b "))) == ["a", "b"] and one(T.csv_set(F.lit(None).cast("string"))) == []
    assert one(T.relative(F.lit("/r/a/b"), "/r/")) == "a/b" and one(T.relative(F.lit("/s/a"), "/r")) == "/s/a"
    assert one(T.task_id(F.lit("!"), [F.lit("f"), F.lit("s")], F.lit(7))) == "rv2_f_s_00007"
    assert one(T.instruction(F.lit("Turn it."), F.lit(1), F.lit(None).cast("int"), F.lit(-1), F.lit(8))) == "Using the source image as context, turn it. Do not change the task premise or redraw the whole image."
    empty = F.array().cast("array<struct<expected:string,got:string,weight:double>>")
    assert one(T.check_score(empty)) is None
    assert one(gates.allowed_edit(F.lit("Color!"), ["color"])) is False and one(gates.allowed_edit(F.lit(None).cast("string"), ["color"])) is True
    part = one(solvers.partition(F.lit(100), 4, F.lit(1)))
    assert part is None and sum(one(solvers.partition(F.lit(36), 4, F.lit(1)))) == 36


def test_summaries_of_nothing(spark):
    e = spark.createDataFrame([], "label string, score double, evidence_modes array<string>, failure string")
    assert summaries.critic(e).count() == 0
    assert summaries.rates(e, bad=F.col("score") > 1).first()["bad"] == 0.0
    assert summaries.conditional_counts(e, bad=F.col("score") > 1).first()["rows"] == 0
    t = spark.createDataFrame([(2, "a"), (1, None), (3, "b"), (4, "b")], "o int, v string")
    assert [tuple(r) for r in summaries.ordered_counts(t, "v", "o").orderBy("place").collect()] == [("b", 2, 1), ("?", 1, 2), ("a", 1, 3)]
    assert summaries.truncated(t, ["o"], 2).count() == 2
