"""Operators against plain Python, with nulls, ties, repeated rows and empty tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, convert, decontam, dedup, gates, neighbors, sampling, solvers, stages, validate


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_accepted_is_the_loop(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("abc"), rng.random() < 0.5) for i in range(300)]
    history = {"c"}
    seen, want = set(history), []
    for i, k, ok in data:
        want.append((i, k in seen))
        if ok and k not in seen:
            seen.add(k)
    df = spark.createDataFrame(data, "i int, k string, ok boolean")
    old = spark.createDataFrame([(h,) for h in history], "k string")
    got = dedup.first_accepted(df, ["k"], [F.col("i")], F.col("ok"), old)
    assert rows(got.select("i", "duplicate")) == sorted(want, key=repr)
    assert dedup.first_accepted(df.limit(0), ["k"], [F.col("i")], F.col("ok")).count() == 0


def test_wins_overlay_pending(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 9), (4, None, 1)], "i int, k string, q int")
    assert rows(dedup.first_wins(df, ["k"], [F.col("i")]).select("i")) == [(1,), (3,), (4,)]
    assert rows(dedup.last_wins(df, ["k"], [F.col("i")]).select("i")) == [(2,), (3,), (4,)]
    assert rows(dedup.best_wins(df, ["k"], F.col("q"), [F.col("i")]).select("i")) == [(2,), (3,), (4,)]
    assert dedup.overlay(df, df.filter("i = 1").withColumn("q", F.lit(0)), "i").filter("q = 0").count() == 1
    assert rows(dedup.pending(df, df.filter("i < 3"), "i").select("i")) == [(3,), (4,)]


def test_gates_keep_their_order(spark):
    df = spark.createDataFrame([(None, None, None), (100, 100, 10), (1000, 300, 99999), (800, 600, 9000)], "width int, height int, bytes int")
    got = [r[0] for r in df.select(gates.strict_image(F.struct("width", "height", "bytes"))).collect()]
    assert got[0] == ["short_side_lt_384", "aspect_gt_2.5", "file_too_small"] and got[3] == []
    assert got[2] == ["short_side_lt_384", "aspect_gt_2.5"]
    lic = spark.createDataFrame([("MIT",), (None,), ("cc-by-nc-4.0",), ("permitted",)], "l string")
    assert [r[0] for r in lic.select(gates.license_reason(F.col("l"))).collect()] == [None, "license_not_in_allowlist", "non_commercial_license", None]
    assert [r[0] for r in lic.select(gates.license_reason(F.col("l"), research=True)).collect()][2] is None


def test_similar_pairs_is_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)]
    for i in range(60, 120):  # small edits of others, and copies
        w = data[rng.randrange(60)][1].split()
        if rng.random() < 0.7:
            w[-1] = rng.choice(words)
        data.append((i, " ".join(w)))
    data += [(200, None), (201, ""), (202, "w1 w2"), (203, "W1, w2!")]

    def grams(t):
        w = (t or "").lower().replace(",", "").replace("!", "").split()
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    g = {i: grams(t) for i, t in data}
    want = {(a, b) for a in g for b in g if a < b and g[a] and len(g[a] & g[b]) * 10 >= len(g[a] | g[b]) * 8}
    df = spark.createDataFrame(data, "i int, text string").withColumn("gram", F.lit("clash")).withColumn("tid", F.lit(1))
    got = decontam.similar_pairs(df, "i", "text")
    assert {(r["i_a"], r["i_b"]) for r in got.collect()} == want
    assert decontam.similar_pairs(df.limit(0), "i", "text").count() == 0


def test_overlaps_leave_out_equal_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five seven"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six", None, None)], "item_id long, text string, normalized_text string, text_hash string")
    assert rows(decontam.overlaps(docs, "doc_id", "text", items)) == [(2, 7, 1, 2, 2)]
    assert rows(decontam.exact_flags(docs, "text", items).select("doc_id", "exact")) == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(decontam.report(docs, "doc_id", "text", items)) == [("high", "exact_benchmark_text", 1)]


def test_text_values_walk(spark):
    df = spark.createDataFrame([(1, {"prompt": "x", "other": "one two three four five"}, ["a b c d e", "short"])], "id int, s struct<prompt:string,other:string>, notes array<string>")
    assert rows(decontam.text_values(df, "id")) == [(1, "notes", "a b c d e"), (1, "other", "one two three four five"), (1, "prompt", "x")]


def test_hamming_pairs_is_brute_force(spark):
    rng = random.Random(1)
    data = [(i, f"{rng.getrandbits(64):016x}") for i in range(80)]
    for i in range(80, 160):
        h = int(data[rng.randrange(80)][1], 16)
        for _ in range(rng.randint(0, 9)):
            h ^= 1 << rng.randrange(64)
        data.append((i, f"{h:016x}"))
    data += [(200, None), (201, "nope"), (202, data[0][1])]
    ok = {i: int(h, 16) for i, h in data if h and h != "nope"}
    want = {(a, b, bin(ok[a] ^ ok[b]).count("1")) for a in ok for b in ok if a < b and bin(ok[a] ^ ok[b]).count("1") <= 6}
    df = spark.createDataFrame(data, "i int, h string")
    assert set(map(tuple, neighbors.hamming_pairs(df, "i", "h").collect())) == want
    with pytest.raises(ValueError):
        neighbors.hamming_pairs(df, "i", "h", 8)


def test_hamming_pairs_of_a_file_are_exact_without_broadcast(spark, tmp_path):
    """Small files give many comparisons, which no broadcast may hold; hashes that share bytes, and a line end that is no digit."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)] + [rng.getrandbits(12) << at for at in (0, 16, 36, 52) for _ in range(15)]
    hashes = base + [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for h in base for _ in range(3)]
    spark.createDataFrame([*enumerate(f"{h:016x}" for h in hashes), (999, f"{hashes[0]:016x}\n")], "i int, h string").write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    apart = [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes))]
    for most in (0, 2, 3, 6, 7):
        assert sorted(map(tuple, neighbors.hamming_pairs(df, "i", "h", most).collect())) == [x for x in apart if x[2] <= most]
    assert "Broadcast" not in neighbors.hamming_pairs(df, "i", "h")._jdf.queryExecution().executedPlan().toString()


def test_cosine_neighbors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "i long, v array<float>")
    assert [(r[0], r[1]) for r in neighbors.cosine_neighbors(df, df, "i", "v", 0.9, block=2).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_splits_cover_once(spark):
    df = spark.range(700).select(F.col("id").alias("k"), F.pmod("id", F.lit(7)).cast("string").alias("g"))
    s = sampling.global_split(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {k: v for k, v in sampling.split_sizes(700).items()}
    assert sorted(r["rn"] for r in sampling.global_rank(df, "k").collect()) == list(range(1, 701))
    assert sampling.ratio_split(df, "g", "k", [("a", 0.6), ("b", 0.4)]).filter("split is null").count() == 0
    assert sampling.validation_split(df, "g", "k", 0.001).filter("is_val").count() == 7
    for n in (0, 5, 599, 600, 4999, 5000, 12345):
        assert sum(sampling.split_sizes(n).values()) == n
    assert sampling.allocate(10, {"a": 0.5, "b": 0.33}, "a") == {"a": 7, "b": 3}
    assert sampling.offsets(None, 2, None)[:3] == [0, 8, 16]
    assert sampling.offsets(100, 2, random.Random(1).randint)[0] == 0


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, None)], "i int, g string")
    assert [r["i"] for r in sampling.round_robin(df, "g", [F.col("i")], 3).collect()] == [4, 2, 1]


PROGRAM = {k: ["x"] for k in validate.PROGRAM} | {"editor_prompt": "long enough to be a prompt", "atomic_checklist": {"visual": [{"id": "C1", "question": "q?", "weight": 1.0}]}}


def test_program_errors(spark):
    data = [
        PROGRAM,
        PROGRAM | {"editor_prompt": "short", "edit_operations": []},
        {k: v for k, v in PROGRAM.items() if k != "knowledge_facts"},
        PROGRAM | {"knowledge_facts": {"a": 1}, "atomic_checklist": []},
        PROGRAM | {"atomic_checklist": [{"id": "C1", "question": "", "weight": 0.3}, {"id": "C2", "question": "q", "weight": "x"}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(data)] + [(9, "nonsense"), (10, "[1]")], "i int, raw string")
    e, w = validate.program_errors(F.col("raw"))
    got = {r["i"]: (r["e"], r["w"]) for r in df.select("i", e.alias("e"), w.alias("w")).collect()}
    assert got[0] == ([], [])
    assert got[1] == ([], ["edit_operations is empty", "editor_prompt is short or not a string"])
    assert got[2] == (["missing required field: knowledge_facts"], [])
    assert got[3][0] == ["knowledge_facts must be a list", "atomic_checklist has no valid checklist items"]
    assert got[4] == ([], ["checklist item C1 has no question", "checklist item C2 has non-numeric weight", "checklist weights sum to 0.3000, expected 1.0"])
    assert got[9][0] == got[10][0] == ["edit_program is not an object"]


def test_anchor_objects(spark):
    kind = "struct<instruction:string,editor_prompt:string,rational_target_description:string,reasoning_chain:string,edit_operations:array<struct<target:string,region_hint:string,change:string>>,atomic_checklist:map<string,array<string>>,risk_flags:array<string>>"
    r = ("paint the big door red", "make that door look red", "the door is now red", "doors can be painted red", [("a", "b", "c")], {"visual": ["q", "r", "s"]}, [])
    df = spark.createDataFrame([(r, ["wooden door"]), (r, ["window"]), (None, None)], f"r {kind}, o array<string>")
    got = [x[0] for x in df.select(validate.refined_errors(F.col("r"), None, F.col("o"))).collect()]
    assert got[0] == [] and got[1] == ["anchor_object_missing:window"] and len(got[2]) == 6


def test_conversions(spark):
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string,result:string>>>>"
    df = spark.createDataFrame([([("user", "hi", None), ("assistant", " think ", [("search", "q", "r")])],), ([],)], f"m {kind}")
    got = [r[0] for r in df.select(convert.rendered_trace(F.col("m"))).collect()]
    assert got == ['<think>think</think>\n<tool_call>{"arguments":"q","name":"search"}</tool_call>\n<tool_response>{"name":"search","result":"r"}</tool_response>', ""]
    raw = spark.createDataFrame([("omniedit", '{"edited_prompt_list": ["a", "b"], "src_img": {"src": "u"}, "edited_img": {"src": "v"}}'), ("anyedit", '{"edit_instruction": "", "input": "x"}'), ("none", "{}")], "s string, raw string")
    assert [r[0] if r[0] is None else tuple(r[0]) for r in raw.select(convert.unified_pair(F.col("raw"), F.col("s"))).collect()] == [("b", "u", "v"), ("x", None, None), None]
    c = spark.createDataFrame([({"visual": ["a", "b"], "other": ["c"], "readability": []},), (None,)], "m map<string,array<string>>")
    first = c.select(convert.weighted_checklist(F.col("m"))).first()[0]
    assert [(x["id"], x["question"]) for x in first] == [("C1", "a"), ("C2", "b"), ("C3", "c")] and abs(sum(x["weight"] for x in first) - 1) < 1e-3


def test_solvers(spark):
    one = spark.range(1)
    grid = [1, 2, 3, 4, 3, 4, 1, 2, 2, 1, 4, 3, 4, 3, 2, None]
    assert one.select(solvers.sudoku4(F.array(*map(F.lit, grid)), F.lit(3), F.lit(3))).first()[0] == 1
    assert one.select(solvers.clock(F.lit(11), F.lit(5), F.lit(1))).first()[0] == "12:05"
    assert one.select(solvers.indicator(F.lit("soap")), solvers.food_edge(F.array(F.lit("a"), F.lit("b")), F.lit(0))).first()[:] == ("blue", "a->b")
    assert one.select(solvers.balance(F.array(F.lit(1)), F.array(F.lit(1)), F.lit("left"))).first()[0] is None
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b")], "i int, s string, t string")
    assert rows(solvers.disagreements(df, "s", "t", "i")) == [(2,), (3,)]


def test_model_stage_keeps_failures(spark):
    def client(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "done")], "i long, p string")
    good, failed = stages.routed(stages.run(df, "i", "p", client, workers=2, done=df.filter("i = 3"), retries=2, pause=0.0))
    assert rows(good) == [(1, "A", None)] and rows(failed) == [(2, None, "RuntimeError: no")]
    assert stages.provider(None, {"a": 1}) == {"a": 1} and stages.provider() is None


def test_audits(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("x", None), ("y", "a")], "p string, q string")
    assert rows(audit.distribution(df, ["p", "q"])) == [("p", "x", 2), ("p", "y", 1), ("q", "?", 1), ("q", "a", 2)]
    audit.write_markdown(spark, "Report", {"d": df}, f"{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text().startswith("# Report\n\n## d\n\n| p | q |")
    diff = spark.range(2000).select(F.col("id").alias("k"), (F.pmod("id", F.lit(5)) - 1.0).alias("d"))
    r = audit.bootstrap(diff, "k", "d").first()
    assert r["pairs"] == 2000 and abs(r["mean_difference"] - 1) < 1e-9 and r["worse"] == 0
    judge = spark.createDataFrame([("a", None, True, False, False, 5), ("b", "e", None, None, None, None), ("c", None, False, True, None, 3)], "task_id string, error string, same boolean, leaks boolean, invented boolean, quality int")
    assert audit.judged(judge).first()[:] == (2, 1, 1, 1, 0, 8) and rows(audit.judge_rejects(judge)) == [("c",)]
