"""Sources, sinks and streams."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates
from millrace.sources import benchmarks, images, jsonl, paged
from millrace.streaming.collection import Collection, file_stream


def write(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_json_scans(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", ['{"a": 1, "b": "x"}', "", '{"a": 2}'])
    bad = write(tmp_path / "b.jsonl", ['{"a": 1}', "{broken", "[1]"])
    assert jsonl.read_strict(spark, good, "a int, b string").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, bad, "a int").collect()
    assert [r["a"] for r in jsonl.read_tolerant(spark, bad, "a int").collect() if r["a"] is not None] == [1]
    ok, errors = jsonl.read_validated(spark, bad, "a int")
    assert [r["a"] for r in ok.collect()] == [1] and sorted((r["line_no"], r["line"]) for r in errors.collect()) == [(2, "{broken"), (3, "[1]")]
    long = write(tmp_path / "long.txt", ["x" if i % 1000 == 999 else "" if i % 7 == 0 else f'{{"a": {i}}}' for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        _, errors = jsonl.read_validated(spark, long, "a int")
        assert sorted(r["line_no"] for r in errors.collect()) == list(range(1000, 20_001, 1000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert jsonl.read_optional(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    assert jsonl.read_shards(spark, f"{tmp_path}/*.jsonl", "a int").select("shard").distinct().count() == 2


def test_json_sink_sorts_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, ("y", "x"))], "z int, a struct<q:string,b:string>")
    assert jsonl.write(df, f"{tmp_path}/out") == 1
    assert jsonl.write(df, f"{tmp_path}/out", append=True) == 1
    lines = [line for p in (tmp_path / "out").glob("*.json") for line in p.read_text().split()]
    assert lines == ['{"a":{"b":"x","q":"y"},"z":1}'] * 2


def test_upsert(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", ['{"k": "a", "v": 1}', '{"k": "b", "v": 2}', "broken"])
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    jsonl.store(spark, f"{tmp_path}/reg", new, "k", "k string, v int")
    jsonl.store(spark, f"{tmp_path}/reg", new.limit(1).withColumn("v", F.lit(4)), "k", "k string, v int")
    assert jsonl.read_strict(spark, f"{tmp_path}/reg", "k string, v int").agg(F.sum("v"), F.count("k")).first()[1] == 2
    got = jsonl.upsert(spark, path, new, "k", "k string, v int").filter("k is not null")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_benchmark_loaders(spark, tmp_path):
    rise = spark.createDataFrame([(1, "do x", " "), (2, None, "ref")], "index int, instruction string, reference string")
    grade = spark.createDataFrame([("t", "text", [("q1", "why?"), (None, "how?")]), ("u", "", None)], "task_id string, text string, questions array<struct<id:string,question:string>>")
    readme = benchmarks.readme_items(benchmarks.numbered_lines(spark, write(tmp_path / "readme.md", ["# KRIS", "nothing", "some Reasoning"])))
    got = benchmarks.collect({"rise": benchmarks.instruction_items(rise), "grade": benchmarks.question_items(grade), "kris": readme}, ["rise", "grade", "kris"], "sample_id")
    assert sorted((r["sample_id"], r["field"]) for r in got.collect()) == [("1", "instruction"), ("2", "reference"), ("readme:0", "readme_line"), ("readme:2", "readme_line"), ("t", "question:"), ("t", "question:q1"), ("t", "text")]
    assert benchmarks.collect({"rise": benchmarks.instruction_items(rise), "grade": benchmarks.question_items(grade)}, ["rise", "grade"], "field", 1).count() == 2


def test_documents_with_defaults(spark, tmp_path):
    jsonl.write_document(spark, {"b": [1, {"c": "é"}], "a": {}}, f"file:{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"b": [1, {"c": "é"}], "a": {}}
    assert jsonl.read_document(spark, f"{tmp_path}/none.json", "a int", [(7,)]).first()["a"] == 7
    assert jsonl.yaml({"a": [1, {"b": "x: y"}], "c": {}, "d": None}) == 'a:\n  - 1\n  -\n    b: "x: y"\nc: {}\nd: null'
    one = write(tmp_path / "one.json", [json.dumps([{"index": 5, "t": "a"}, {"t": "b"}])])
    two = write(tmp_path / "two.json", [json.dumps({"data": [{"task_id": "x"}, {}]}, indent=1)])
    assert [r["sample_id"] for r in benchmarks.document_rows(spark, one, "index").collect()] == ["5", "1"]
    assert [r["sample_id"] for r in benchmarks.document_rows(spark, two, "task_id", "index").collect()] == ["x", "1"]


def test_scoring_service(spark, tmp_path):
    from millrace.functions import reward as R
    from millrace.streaming import scoring

    rows = [("1", scoring.VERIFIER, '{"execution": 0.9}'), ("2", scoring.VERIFIER, "[1]"), ("3", "/other", "{}"), ("4", scoring.AGENT, None)]
    spark.createDataFrame(rows, "id string, path string, body string").coalesce(1).write.parquet(f"{tmp_path}/in")
    score = lambda item: F.struct(F.round(R.fuse({"execution": item["execution"]}), 4).alias("score"))
    stream = file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    for _ in range(2):
        scoring.serve(stream, "execution double", {scoring.VERIFIER: score, scoring.AGENT: score}, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r["id"]: (r["status"], r["body"]) for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": 200, "2": 400, "3": 404, "4": 400} and "score" in got["1"][1]


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(640, 480))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["width"], r["height"], r["mode"]) for r in images.records(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480, "L"), "b.jpg": ("jpeg", None, None, None)}
    df = spark.createDataFrame([(f"file:{tmp_path}/a.png",), ("gone",), (None,)], "p string")
    assert images.missing(df, "p", images.listing(spark, str(tmp_path))).count() == 2
    gray = spark.createDataFrame([([0] * 32 + [255] * 32, [0] * 32 + [254] + [255] * 31), (None, None)], "a array<int>, b array<int>")
    assert [r[0] for r in gray.select(images.average_hash(F.col("a"))).collect()] == ["00000000ffffffff", None]
    assert gray.select(images.pixel_diff(F.col("a"), F.col("b"))).first()[0] == 1


def test_paged_source(spark):
    def fetch(offset, length):
        if offset == 99:
            raise ValueError("gone")
        return {"rows": [{"n": offset + i} for i in range(min(length, 2))], "total": 100}

    paged.register(spark, "testrows", fetch)
    got = sorted((r["offset"], r["row_idx"], r["raw"], r["error"]) for r in paged.pages(spark, "testrows", [0, 10], 16).collect())
    assert [g[2] for g in got] == ['{"n": 0}', '{"n": 1}', '{"n": 10}', '{"n": 11}']
    assert paged.pages(spark, "testrows", [99], 16).first()["error"] == "ValueError: gone"
    def broken(offset, length):
        raise ValueError("gone")

    paged.register(spark, "firstrows", broken, lambda: {"rows": [{"n": 0}]})
    assert [(r["row_idx"], r["error"]) for r in paged.pages(spark, "firstrows", [0, 5], 16).orderBy("offset").collect()] == [(0, None), (None, "ValueError: gone")]
    assert paged.row_count(lambda: {"total": 7}) == 7 and paged.row_count(lambda: {"total": 0}) is None and paged.row_count(lambda: broken(0, 1)) is None
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    facts = spark.createDataFrame([("a", "f", None), ("a", None, "late"), ("b", None, "404")], "k string, facts string, error string")
    assert sorted(tuple(r) for r in paged.enriched(cat, facts, "k").collect()) == [("a", "f", None), ("b", None, "404"), ("c", None, None)]
    calls = []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise paged.Busy()
        return {"rows": []}

    assert paged.with_retries(busy, 3, 0.0) == {"rows": []} and len(calls) == 3


def test_stream_is_the_batch(spark, tmp_path):
    """Cycles as a stream accept what one batch over all rows in the same order accepts; a restart adds nothing."""
    data = [(i, "abcdefgh"[i * 7 % 8], i % 3 > 0) for i in range(40)]
    for c in range(4):
        spark.createDataFrame(data[c * 10 : c * 10 + 10], "i long, k string, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    seen, want = set(), set()
    for i, k, ok in data:
        if ok and k not in seen:
            seen.add(k)
            want.add(i)
    c = Collection(spark, f"{tmp_path}/out", ["k"], ["i"], lambda: gates.reasons(gates.when(~F.col("ok"), "not_ok")))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):
        c.run(file_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/check")
    assert {r["k"] for r in c.accepted().collect()} == seen and c.accepted().count() == len(want)
    assert c.accepted().count() + c.rejected().count() == 40
    assert sum(r["rows"] for r in c.status().collect()) == 40
    c.merge(spark.read.parquet(f"{tmp_path}/in"), 0)
    assert c.accepted().count() == len(want)
    # a cycle that broke off before its status was written gives the same rows again
    import shutil

    shutil.rmtree(f"{tmp_path}/out/status/cycle=3")
    c.merge(spark.createDataFrame([x for x in data[30:]], schema), 3)
    assert c.accepted().count() == len(want)


def test_documents_parse(spark, tmp_path):
    path = write(tmp_path / "d.json", [json.dumps([{"a": 1}, {"a": 2}], indent=1)])
    assert jsonl.read_document(spark, path, "a int").count() == 2
