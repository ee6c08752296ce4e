"""Each operator against brute force, an exact round trip or hand-made cases; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.asread import as_read, read_words
from millrace.llm import nearset as ns
from millrace.llm import p1_cross_split as p1
from millrace.llm import p2_incremental as p2
from millrace.llm import p3_grouped_splits as p3
from millrace.llm import p4_near_duplicates as p4
from millrace.llm import p5_encoding as p5
from millrace.llm import p6_leakage as p6
from millrace.llm import p7_quality as p7
from millrace.llm import queries as q

NOUNS = [f"{a}{b}" for a in ("lamp", "chair", "tree", "boat", "stone", "cloud", "bridge", "fence", "wheel", "glass") for b in ("", "s", "let", "wood", "side", "work")]


def rng(n):
    return random.Random(n)


def sentence(r, n=None):
    w = [r.choice(NOUNS) for _ in range(n or r.randint(12, 40))]
    for _ in range(2):
        w.insert(r.randrange(len(w)), "".join(r.choices("bdfgklmnprst", k=3)) + str(r.randrange(10_000)))
    return " ".join(w)


def edited(r, text, k):
    w = text.split()
    for _ in range(k):
        i = r.randrange(len(w))
        if r.random() < 0.5:
            w[i] = "".join(r.choices("aeioubdgklm", k=6))
        else:
            w.insert(i, r.choice(NOUNS))
    if r.random() < 0.3:
        cut = r.randrange(len(w))
        w = w[cut:] + w[:cut]
    return r.choice([str.upper, str.title, str])(" ".join(w)).replace("a", r.choice(["a", "á", "a\u200b"]))


def corpus(seed, n=150):
    r = rng(seed)
    texts = [sentence(r) for _ in range(n)]
    texts += [edited(r, texts[r.randrange(n)], r.randint(0, 4)) for _ in range(n)]
    texts += [texts[0]] * 5 + [None, "", "   ", "too few words", "x " * 20_000 + "a b c d e", "x " * 20_000 + "a b c d e f"]
    return [(f"k{i:05d}", t) for i, t in enumerate(texts)]


def near(a, b):
    return len(a) >= 5 and len(b) >= 5 and len(a & b) * 10 >= len(a | b) * 8


def near_pairs(rows):
    s = [(k, frozenset(read_words(t))) for k, t in rows]
    return {(x, y) for x, a in s for y, b in s if x < y and near(a, b)}


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_as_read():
    assert read_words("<b>Café</b>&nbsp;ｗｉｄｅ so\u00adft\u200b co\u0301py ﬁve") == ["cafe", "wide", "soft", "copy", "five"]
    assert read_words(None) == read_words("") == [] and as_read("a < b") == "a < b"


def clash(df):
    for c in ("sid", "n", "bm", "words", "key", "_text", "cnt"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_p4_is_brute_force(spark):
    rows = corpus(4)
    df = clash(spark.createDataFrame(rows + rows[:20], "task_id string, text string"))
    want, got = near_pairs(rows), pairs(p4.near_pairs(df))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60
    assert p4.near_pairs(df.limit(0)).count() == 0


def test_p4_pairs_that_no_band_has(spark):
    """Template words in all texts weigh little, odd ones much: bands miss many such pairs."""
    r = rng(44)
    template = r.sample(NOUNS, 40)
    rows = [(f"k{i:03d}", " ".join([*template, *(f"odd{i}x{j}" for j in range(4))])) for i in range(120)]
    want = near_pairs(rows)
    assert len(want) == 120 * 119 // 2 and pairs(p4.near_pairs(spark.createDataFrame(rows, "task_id string, text string"))) == want


def test_p4_hot_bands_of_a_template(spark):
    """400 pairs of a template of 22 words, two words of the pair and three of each record: only those of a pair are true, all bands are hot."""
    template = [f"t{i}" for i in range(22)]
    rows = [(f"k{i:03d}{s}", " ".join([*template, f"p{i}x", f"p{i}y", *(f"o{i}{s}{j}" for j in range(3))])) for i in range(400) for s in "ab"]
    assert pairs(p4.near_pairs(spark.createDataFrame(rows, "task_id string, text string"))) == {(f"k{i:03d}a", f"k{i:03d}b") for i in range(400)}


def test_p4_weighted_similarity_has_a_floor():
    import numpy as np

    counts = np.zeros(1 << ns.COUNT_BITS, np.int32)
    counts[:40] = 1000
    w = p4.weights(np.arange(50, dtype=np.int32), 1000, counts)
    assert w[0] == 1 and abs(w[45] - p4.RATIO) < 1e-9
    assert abs(8 * w[0] / (8 * w[0] + 2 * w[45]) - p4.WEIGHTED) < 1e-9
    assert (1 - p4.WEIGHTED**p4.ROWS) ** p4.BANDS < 3e-3


def test_p4_samples_estimate_weighted_similarity():
    import numpy as np

    words, weight = np.arange(100, 160, dtype=np.int32), np.linspace(0.5, 4, 60)
    a, b = np.arange(0, 45), np.arange(15, 60)
    true = weight[15:45].sum() / weight.sum()
    same = np.mean([samples[a].min() == samples[b].min() for samples in (p4.samples(words, weight, i) for i in range(1500))])
    assert abs(same - true) < 0.05


def seeds(rows):
    return [(k, sp, t, u, "c") for k, sp, t, u in rows]


def test_p1_is_brute_force(spark):
    r = rng(1)
    base = corpus(11, 120)
    splits = ["sft_train", "SFT_Train ", "sft_val", "bench_test", "hard_heldout", "rl_prompt_train", None]
    targets = [r.choice([q.STANDING[0], q.STANDING[1].upper(), None, ""]) if r.random() < 0.6 else t for _, t in corpus(12, 120)]
    rows = [(k, r.choice(splits), t, u) for (k, t), u in zip(base, targets, strict=True)]
    side = {k: None if s is None else {"sft_train": True, "rl_prompt_train": None}.get(s.strip().lower(), False) for k, s, _, _ in rows}
    want = set()
    for field in (2, 3):
        standing = [set(read_words(s)) for s in q.STANDING]
        texts = [(x[0], x[field]) for x in rows if field == 2 or set(read_words(x[3])) not in standing]
        want |= {(a, b) for a, b in near_pairs(texts) if {side[a], side[b]} == {True, False}}
    df = clash(spark.createDataFrame(rows + rows[:30], "task_id string, split string, instruction string, expected_target string"))
    got = pairs(p1.found(df, q.STANDING))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 15
    assert p1.found(df.limit(0)).count() == 0
    report = p1.report(df.withColumn("source", F.lit("s")), q.STANDING).collect()
    assert sum(x["pairs"] for x in report) == len(got)
    o = p1.record_overlap(df, q.STANDING).collect()
    assert all(0 <= x["fraction"] <= 1 for x in o)


def test_p1_hot_short_templates(spark):
    """Six templates of eight words, each in 240 records with one word of their own: all pairs are true, most chunks are hot."""
    r = rng(17)
    rows, want = [], 0
    for t in range(6):
        words = [f"t{t}w{i}" for i in range(8)]
        for i in range(240):
            w = list(words)
            w.insert(r.randrange(9), f"own{t}x{i}")
            rows.append((f"k{t}{i:03d}", "sft_val" if i < 10 else "sft_train", " ".join(w), None))
        want += 10 * 230
    got = pairs(p1.found(spark.createDataFrame(rows, "task_id string, split string, instruction string, expected_target string")))
    assert len(got) == want == 13_800


def test_p1_chunks_survive_edits():
    """Of pairs with as many changed words as nearly equal texts can have, none lose all chunks of both cuts."""
    import numpy as np

    r = np.random.default_rng(5)
    for n in (9, 23, 24, 47, 48, 95, 96, 300):
        lost = 0
        for _ in range(400):
            a = r.integers(-(2**31), 2**31, n).astype(np.int32)
            b = a.copy()
            b[r.choice(n, n // 9, replace=False)] = r.integers(-(2**31), 2**31, n // 9)
            seq, ends, level = np.concatenate([a, b]), np.array([0, n, 2 * n]), p1.levels(np.array([n, n]))
            shared = 0
            for seed in p1.SEEDS:
                begin, stop, row = p1.chunks(seq, ends, level, seed)
                d = p1.digests(seq, begin, stop)
                shared += len(np.intersect1d(d[row == 0], d[row == 1]))
            lost += not shared
        assert not lost


def test_p1_hot_chunks_are_grown(spark, monkeypatch):
    """With every digest hot at once, runs of chunks still find the pairs."""
    monkeypatch.setattr(ns, "HOT", 1)
    r = rng(9)
    base = [sentence(r) for _ in range(40)]
    rows = [(f"a{i:03d}", "sft_train", t, None) for i, t in enumerate(base)] + [(f"b{i:03d}", "sft_val", t + " final", None) for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "task_id string, split string, instruction string, expected_target string")
    assert {(f"a{i:03d}", f"b{i:03d}") for i in range(40)} <= pairs(p1.found(df))


@pytest.mark.parametrize("words", [10, 12, 20])
def test_p1_hot_template_loses_nothing(spark, monkeypatch, words):
    """All chunks are those of one template, and an edit leaves no long run of them."""
    monkeypatch.setattr(ns, "HOT", 5)
    r = rng(words)
    base = r.sample(NOUNS, words)
    texts = []
    for i in range(240):
        w = list(base)
        w[i % words] = f"odd{i}"
        texts.append((f"k{i:04d}", " ".join(w)))
    rows = [(k, "sft_train" if i // words % 2 else "sft_val", t, None) for i, (k, t) in enumerate(texts)]
    side = {k: s for k, s, _, _ in rows}
    want = {(a, b) for a, b in near_pairs(texts) if side[a] != side[b]}
    assert len(want) > 500
    assert pairs(p1.found(spark.createDataFrame(rows, "task_id string, split string, instruction string, expected_target string"))) == want


PAIR = "sample_id string, batch_number int, dataset_id string, provenance struct<split:string,row_idx:bigint>, instruction string, ingested_at timestamp"
CATALOG = [("Ann/first", None), ("Ann/first_2", None), ("Bob/copy", "Ann/first"), ("Cy/copy", "Bob/copy")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "dataset_id string, mirror_of string")


def edit_pairs(seed):
    r = rng(seed)
    texts = corpus(seed, 80)
    spell = [None, "Ann/first", "hub://datasets/ANN/FIRST", "Bob%2Fcopy", "cy/copy@main", "Ann/first_2", "https://hub.example/datasets/Ann/first_2/", "No/where"]
    now = dt.datetime(2025, 1, 1)
    return [(f"p{i:04d}", r.choice([1, 2, 3, 3, None]), r.choice(spell), (r.choice(["train", "extra", None]), r.choice([None, -1, *range(25)])), t, now) for i, (_, t) in enumerate(texts)]


def replay(rows, taken=None):
    root = {None: None, "Ann/first": "a", "hub://datasets/ANN/FIRST": "a", "Bob%2Fcopy": "a", "cy/copy@main": "a", "Ann/first_2": "b", "https://hub.example/datasets/Ann/first_2/": "b", "No/where": None}
    keys, sets, no = taken or (set(), [], set())
    for k, _, d, (sp, i), t, _ in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[0])):
        key = (root[d], sp, i) if root[d] and sp and i is not None and i >= 0 else None
        w = frozenset(read_words(t))
        if key in keys or any(near(w, s) for s in sets):
            no.add(k)
            continue
        if key:
            keys.add(key)
        sets.append(w)
    return no


def test_p2_replays_all_batches(spark):
    rows = edit_pairs(2)
    df = clash(spark.createDataFrame(rows + rows[:25], PAIR))
    assert {r[0] for r in p2.edit_rejected(df, catalog(spark)).collect()} == replay(rows)
    assert p2.edit_rejected(df.limit(0), catalog(spark)).count() == 0


def test_p2_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ns, "HOT", 1)
    rows = edit_pairs(7)
    assert {r[0] for r in p2.edit_rejected(spark.createDataFrame(rows, PAIR), catalog(spark)).collect()} == replay(rows)


def test_p2_large_sets_lose_nothing(spark):
    """Sets of 36 words and more that differ in as many words as nearly equal sets can."""
    rows, r = [], rng(36)
    for i in range(600):
        n = r.choice([36, 45, 50, 56, 71, 72, 100])
        k = n // 9
        pool = [f"w{r.randrange(1 << 40)}" for _ in range(n + k)]
        rows += [(f"a{i}", " ".join(pool[:n])), (f"b{i}", " ".join(pool[k:]))]
        assert near(set(pool[:n]), set(pool[k:]))
    sets = ns.classes(ns.word_sets(spark.createDataFrame(rows, "k string, text string"), "text", "k"))
    assert p2.near_links(sets.persist()).count() == 600


def test_p2_ledger_is_the_replay(spark, tmp_path):
    rows = [x for x in edit_pairs(3) if x[1] is not None]
    ledger, got = p2.Ledger(spark, str(tmp_path)), set()
    for b in (1, 2, 3):
        got |= {r[0] for r in ledger.accept(spark.createDataFrame([x for x in rows if x[1] == b], PAIR), catalog(spark)).collect()}
    assert got == replay(rows)
    other = p2.Ledger(spark, str(tmp_path / "loaded"))
    other.load(spark.createDataFrame([x for x in rows if x[1] < 3], PAIR), catalog(spark))
    last = {r[0] for r in other.accept(spark.createDataFrame([x for x in rows if x[1] == 3], PAIR), catalog(spark)).collect()}
    assert last == {k for k in got if dict((x[0], x[1]) for x in rows)[k] == 3}


def test_p2_ledger_reads_what_a_small_batch_needs(spark, tmp_path, monkeypatch):
    rows = [x for x in edit_pairs(31) if x[1] is not None]
    ledger = p2.Ledger(spark, str(tmp_path))
    ledger.load(spark.createDataFrame(rows, PAIR), catalog(spark))
    kept = spark.read.parquet(f"{tmp_path}/keys")
    some = kept.select("key").distinct().orderBy("key").limit(20)
    near = ledger.stored("keys", some)
    assert near.count() == kept.join(some, "key", "left_semi").count() < kept.count() / 4
    assert "PushedFilters: [In(key, [" in near._jdf.queryExecution().executedPlan().toString()
    assert ledger.stored("keys", some.limit(0)).count() == 0
    monkeypatch.setattr(p2, "FEW", 5)
    assert ledger.stored("keys", some).count() == kept.count()


def test_p2_ledger_of_pool_images(spark, tmp_path):
    rows = [(f"i{i}", 1 + i % 3, (f"{i % 7:064x}" if i % 5 else None, 5)) for i in range(40)]
    schema = "image_id string, batch_number int, image struct<sha256:string,bytes:bigint>"
    ledger, got = p2.Ledger(spark, str(tmp_path)), set()
    for b in (1, 2, 3):
        got |= pairs(ledger.accept_pool(spark.createDataFrame([x for x in rows if x[1] == b], schema)))
    assert got == pairs(p2.pool_rejected(spark.createDataFrame(rows, schema)))


def test_p2_pool(spark):
    d = "ab" * 32
    rows = [("i1", 1, (d, 5)), ("i2", 1, (f" sha256:{d.upper()}\t", 9)), ("i0", 2, (d, 5)), ("i3", 1, (d, 0)), ("i4", 1, (None, 5)), ("i5", 1, ("", 5)), ("i6", 1, (p2.EMPTY_DIGEST, 0)), ("i7", 2, (p2.EMPTY_DIGEST, None)), ("i1", 1, (d, 5)), ("i8", None, (d, 1))]
    df = spark.createDataFrame(rows, "image_id string, batch_number int, image struct<sha256:string,bytes:bigint>")
    assert pairs(p2.pool_rejected(df)) == {("i2",), ("i0",), ("i8",)}
    assert p2.pool_rejected(df.limit(0)).count() == 0


def test_p2_pivot_distances_obey_the_triangle_inequality():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 60, 30)).astype(np.int32) for _ in "ab")
    s = [p2.pivot_distances(x, np.zeros(len(x), int), 1, 16)[0].astype(float) for x in (a, b, np.setxor1d(a, b))]
    assert (abs(s[0] - s[1]) <= s[2]).all() and (s[2][s[0] != s[1]] >= 2.0**32).all()


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = {}
    for x in up:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(c) for c in out.values()}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rng(i).randrange(120), rng(i + 500).randrange(120)) for i in range(90)], [(5, 5)], []])
def test_p3_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {}
    for v, root in p3.components(df).collect():
        got.setdefault(root, set()).add(v)
    assert {frozenset(c) for c in got.values()} == components(edges)


def test_p3_keys(spark):
    paths = ["data/x/A_1.JPG", "./data/x/a_1.jpg", "/srv/r/data/x/a_1.jpg", "C:\\r\\data\\x\\a_1.jpg", "file:///srv/r/data/%78/a%5F1.jpg", "data/y/../x//a_1.jpg", " data/x/a_1.jpg ", "data/x_old/a_1.jpg", None, " ", "bad%zz"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(p3.file_key(F.col("p"))).collect()] == ["data/x/a_1.jpg"] * 7 + ["data/x_old/a_1.jpg", None, None, "bad%zz"]
    names = ["Ann/first-x", " ann/FIRST-x/", "hub://datasets/ANN/FIRST-X", "https://hub.example/datasets/Ann/first-x", "Ann%2Ffirst-x", "Ann/first-x@main", "Ann/first_x", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(names)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(p3.dataset_key(F.col("p"))).collect()] == ["ann/first-x"] * 6 + ["ann/first_x", None, None]


SEED = "task_id string, source_image string, source_image_provenance struct<artist:string>"


def test_p3_groups_and_splits(spark):
    r = rng(3)
    artists = [None, "", "Unknown", "N/A", "-", "Ann&nbsp;Bee", "ann bee", "<span>Cy Dee</span>\n", "Cý Dee\u200b", *(f"Artist {chr(97 + i)}{i}" for i in range(60))]
    seeds = [(f"s{i:04d}", r.choice([None, "", f"data/{r.randrange(150)}.png"]), (r.choice(artists),)) for i in range(300)]
    pairs_ = [(f"e{i:04d}", r.choice([None, "Ann/first", "BOB/copy", "cy/copy", "Ann/first_2", "No/where"])) for i in range(200)]
    s = clash(spark.createDataFrame(seeds + seeds[:10], SEED))
    e = spark.createDataFrame(pairs_ + pairs_[:10], "sample_id string, dataset_id string")
    rel = p3.related(s, e, catalog(spark)).persist()
    got = {x["record_id"]: (x["group_id"], x["size"]) for x in p3.groups(rel).collect()}
    edges = [(k, k) for k, _, _ in seeds] + [(k, k) for k, _ in pairs_]
    for k, image, (artist,) in seeds:
        who = " ".join(read_words(artist))
        edges += [(k, ("f", image))] * bool(image) + [(k, ("w", who))] * (who not in p3.NOBODY)
    root = {"Ann/first": "x", "BOB/copy": "x", "cy/copy": "x", "Ann/first_2": "y"}
    edges += [(k, ("d", root[d])) for k, d in pairs_ if d in root]
    for c in components(edges):
        keys = {x for x in c if isinstance(x, str)}
        for k in keys:
            assert got[k] == (min(keys), len(keys))
    splits = p3.assign(p3.groups(rel)).collect()
    assert len(splits) == 500 and len({(x["group_id"], x["split"]) for x in splits}) == len({x["group_id"] for x in splits})
    assert p3.related(s.limit(0), e.limit(0), catalog(spark)).count() == 0
    assert p3.assign(p3.groups(p3.related(s.limit(0), e.limit(0), catalog(spark)))).count() == 0


def test_p3_take_closest():
    def best(sizes, target):
        totals = {0}
        for s, m in sizes.items():
            totals = {t + k * s for t in totals for k in range(m + 1)}
        return min(abs(t - target) for t in totals)

    r = rng(8)
    for _ in range(150):
        sizes = {s: r.randint(1, 6) for s in r.sample(range(1, 400), r.randint(1, 5))}
        target = sum(s * m for s, m in sizes.items()) // r.choice([10, 10, 3, 1])
        taken = p3.take_closest(sizes, target)
        assert all(0 <= taken[s] <= sizes[s] for s in taken)
        assert abs(sum(s * k for s, k in taken.items()) - target) == best(sizes, target)
    assert p3.take_closest({}, 0) == {} and p3.take_closest({7: 1}, 0).get(7, 0) == 0
    assert sum(s * k for s, k in p3.take_closest({1_000_000: 1, 3: 5}, 100_001).items()) == 15


def test_p3_take_closest_is_bounded():
    """2,000 distinct sizes of 163 million records: seconds, and no more than 200 MB."""
    import time
    import tracemalloc

    r = rng(3)
    sizes = {s: max(1, 82_000 // s + r.randint(0, 1)) for s in r.sample(range(1, 160_000), 2000)}
    target = sum(s * m for s, m in sizes.items()) // 10
    tracemalloc.start()
    began = time.process_time()
    taken = p3.take_closest(sizes, target)
    whole, gap = p3.subset_sum(sizes, target)
    assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert sum(s * k for s, k in taken.items()) == target == sum(s * k for s, k in whole.items()) and gap == 0


def test_p5_is_the_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = p5.read_ranks(p5.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    r = rng(5)
    texts = [None, "", " ", "\n\n \t", "it's <|endoftext|> 12,345", "编辑 图片。", "🙂👍🏽 naïve\u00a0x\u3000y", "a" * 3000, "xyzzy" * 500, "\u2028 b", "שלום עולם"]
    texts += ["".join(r.choice(["the ", "Ünï", "q", "zx", "7", "\n", " ", "—", "漢", "'ll", "_"]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    df = clash(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).withColumn("pieces", F.lit(1))
    got = {k: list(v) for k, v in p5.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert b"".join(enc.decode_tokens_bytes(got[10])).decode() == texts[10]
    assert p5.encode(df.limit(0)).count() == 0
    assert p5.encode(df.unionByName(df)).count() == 2 * len(texts)


def test_p5_long_pieces(spark):
    """A piece of 64 KB is merged as the tokenizer does, in less than two seconds; pieces around LONG alike."""
    import time

    tiktoken = pytest.importorskip("tiktoken")
    ranks = p5.read_ranks(p5.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=r"\p{L}+|[^\p{L}]+", mergeable_ranks=ranks, special_tokens={})
    table, r = p5.Table(ranks), rng(64)
    base = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pieces = ["".join(r.choices(base, k=n)).encode() for n in (p5.LONG - 1, p5.LONG, p5.LONG + 1, 5000)] + [b"a" * 4001, ("漢字" * 900).encode()]
    flat, begin = p5.encode_pieces(table, pieces)
    for i, piece in enumerate(pieces):
        assert flat[begin[i] : begin[i + 1]].tolist() == enc.encode_ordinary(piece.decode())
    long = "".join(r.choices(base, k=1 << 16)).encode()
    began = time.process_time()
    flat, _ = p5.encode_pieces(table, [long])
    assert time.process_time() - began < 2 and b"".join(enc.decode_tokens_bytes(flat.tolist())) == long


def test_p6_holds_half_with_one_word_in_eight(spark):
    r = rng(66)
    word = lambda: "".join(r.choices("bdfgklmnprstaeiou", k=9))
    item = [word() for _ in range(100)]
    seventh = [word() if k % 7 == 3 else w for k, w in enumerate(item[:56])]
    ninth = [word() if k % 9 == 4 else w for k, w in enumerate(item[:56])]
    together = item[:20] + [word() for _ in range(7)] + item[20:60]
    turned = item[:45] + [word()] + item[46:48] + [word()] + item[49:50] + [word()]
    docs = {"48 words": item[:48], "50 words": item[10:60], "seventh": seventh, "ninth": ninth, "together": together, "short ends": turned, "halves": item[:30] + [word() for _ in range(40)] + item[30:60]}
    d = spark.createDataFrame([(k, " ".join([word() for _ in range(15)] + w + [word() for _ in range(15)])) for k, w in docs.items()], "doc_id string, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x["doc_id"] for x in p6.leaks(d, b).collect()} == {"50 words", "ninth", "together", "short ends"}


def test_p6_joined_index_is_the_broadcast_one(spark):
    """A closing sentence of all items, in all documents, is a key of no item that has enough others."""
    r = rng(67)
    close = "please answer only with the name of the object that has changed".split()
    items = [(i, " ".join([*sentence(r, 40).split(), *close])) for i in range(80)] + [(99, " ".join(close)), (100, None)]
    docs = []
    for i in range(60):
        w = items[r.randrange(80)][1].split()
        docs.append((i, " ".join([sentence(r, 10), *w[: r.choice([4, 12, 30, 52])], sentence(r, 5), *close])))
    d, b = spark.createDataFrame([*docs, (77, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(tuple(x) for x in p6.leaks(d, b, block=n).collect()) for n in (1000, 5))
    assert one == two and len(one) > 80


def test_p6_planted_passages(spark):
    r = rng(6)
    items = [(i, sentence(r, r.randint(8, 60))) for i in range(40)]
    items += [(90, items[0][1]), (91, None), (92, "  "), (93, "only seven words are in this one")]
    docs, want = [], set()
    for i in range(120):
        k, text = items[r.randrange(40)]
        w = text.split()
        n = len(w)
        part = r.choice([0.0, 0.25, 0.6, 1.0])
        size = int(n * part + 0.999) if part != 0.25 else n // 4
        at = r.randrange(n - size + 1)
        passage = w[at : at + size]
        for _ in range(size // 16):
            passage[r.randrange(1, len(passage) - 1)] = "changed"
        quoted = r.choice([" ".join, lambda p: "> " + "\n> ".join(p), lambda p: "- " + " ".join(p).upper(), lambda p: "\\n".join(p), lambda p: "&quot;" + " ".join(p) + "&quot;"])(passage)
        docs.append((i, f"{sentence(r, 30)}.\n{quoted}\n{sentence(r, 30)}"))
        if part > 0.5:
            want |= {(i, k)} | ({(i, 90)} if k == 0 else set())
    docs += [(500, None), (501, ""), (502, items[93 - 90 + 40][1]), (503, "word " * 50_000)]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(x["doc_id"], x["item_id"]) for x in p6.leaks(d, b).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in p6.leaks(d, b, block=7).collect()} == want
    assert p6.leaks(d.limit(0), b).count() == 0 and p6.leaks(d, b.limit(0)).count() == 0


def test_p6_winnowing_keeps_every_long_span():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        span = r.integers(0, 1 << 62, p6.K + p6.WINDOW - 1).astype(np.uint64)
        prints = []
        for _ in "ab":
            t = np.concatenate([r.integers(0, 1 << 62, r.integers(0, 9)).astype(np.uint64), span, r.integers(0, 1 << 62, r.integers(0, 9)).astype(np.uint64)])
            prints.append(set(p6.winnow(t, np.zeros(len(t), int))[1].tolist()))
        assert prints[0] & prints[1]


PROSE = {
    "en": "The committee met on Tuesday and agreed that the bridge should be repaired before the winter, although nobody could say who would pay for it.",
    "de": "Der Ausschuss hat am Dienstag beschlossen, dass die Brücke noch vor dem Winter repariert werden muss, auch wenn niemand weiß, wer das bezahlt.",
    "fr": "Le comité a décidé mardi que le pont serait réparé avant l'hiver, mais personne ne sait encore qui va payer pour les travaux.",
    "es": "El comité decidió el martes que el puente se repararía antes del invierno, aunque nadie sabe todavía quién va a pagar las obras.",
    "zh": "委员会星期二决定在冬天以前把桥修好，虽然现在还没有人知道谁来付这笔钱。",
    "short": "I think so too.",
    "wrapped": "The committee met on Tuesday and agreed\nthat the bridge should be repaired before\nthe winter, although nobody could say who\nwould pay for it.",
    "careless": "well i dont know what they were thinking when they did that but it was not a good idea and now we have to fix it",
    "list inside": "The committee met on Tuesday and agreed that the bridge should be repaired before the winter.\n\n- bolts\n- planks\n\nAfter that they went home, and the rest was left to the town.",
}
JUNK = {
    "bullets": "* red lamp\n* old chair\n* wet stone\n* big tree",
    "plain list": "red lamp\nold chair\nwet stone\nbig tree\nslow boat",
    "checklist": "[x] Is the lamp still there?\n[ ] Is the chair red?\n[ ] Has the stone been moved?",
    "keywords": "red lamp, old chair, wet stone, big tree, slow boat, tall fence, round wheel",
    "pairs": "Lamp: yes\nChair: 12\nStone: grey\nTree: no",
    "csv": "name,size,count\nlamp,0.2,31\nchair,0.7,12\nstone,0.9,44",
    "markdown": "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |",
    "json": '{"a": "1", "b": "x"}\n{"a": "2", "b": "y"}',
    "log": "2025-05-14T19:18:05Z [WARN] worker-27 rc=4053\n2025-05-14T19:18:06Z [INFO] worker-2 rc=1",
    "base64": "T7w5cRQZ62yoL9kGhBMOGVoIgSWCa7n5pyDrdUxuzwnaVTDyNTkE\neYB6PqX6rEcA35iycRDQIrWu6fdl9cjlrLT9XLzUOsAYe3LZb4hH",
    "symbols": "Z]{rof/n <ri_es*that _he< w@}l{ rat~<r f~[]ze \\he \\ho]} {e@c@ %}|n\\*cce",
    "long menu": " » ".join(["Home", "About", "Next page", "Terms", "Search", "Top"] * 11),
    "one line of base64": "T7w5cRQZ62yoL9kGhBMOGVoIgSWCa7n5pyDrdUxuzwnaVTDyNTkEeYB6PqX6rEcA35iycRDQIrWu6fdl9cjlrLT9XLzUOsAYe3LZb4hH",
    "menu": "Home » Login » Search » Terms » Home » Gallery » Share » Login",
    "gibberish": "Xgra sqxjsac ghdkp ffn juzwo ketqlot zu zobhket. Gnts qbaf wrtpl kkdj fhgn qwrt.",
    "mojibake": "Nous avons vÃ©rifiÃ©Ã¢â‚¬â„¢ ï¿½ï¿½ Ã©Ã¼ Â§Ã¢â‚¬â„¢ ï¿½ï¿½ Ã©Ã¼",
    "repeated": "edit photo download " * 40,
    "sentence": "The lamp was moved to the left.\n" * 12,
}


def test_p7_cases(spark):
    texts = PROSE | JUNK | {"null": None, "empty": "", "blank": " \n\t", "long": PROSE["en"] + " " + " ".join(f"The lamp number {i} was then moved to the left of the chair." for i in range(5000))}
    df = clash(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    got = {r["doc_id"]: r for r in p7.quality(df).collect()}
    assert {k for k in texts if got[k]["reason"] is not None} == set(JUNK)
    assert got["null"]["n_words"] == 0 and got["blank"]["mean_word"] is None
    s = got["short"]
    assert (s["n_words"], s["mean_word"], s["ends"], s["bullets"]) == (4, 2.75, 1.0, 0.0)
    assert p7.quality(df.limit(0)).count() == 0
    assert p7.quality(df.unionByName(df)).count() == 2 * len(texts)


def test_p7_published_rules(spark):
    """Each published rule has its value and verdict; only texts of MIN_WORDS words are judged by them."""
    r = rng(7)
    prose = " ".join([PROSE["en"]] * 3)
    texts = {
        "prose": " ".join(PROSE[k] for k in ("en", "careless", "list inside")), "gopher_mean_word_length": " ".join("Donaudampfschifffahrtsgesellschaftskapitaen der und die" for _ in range(20)), "gopher_symbol_to_word": prose + " # # # # # # # # # # # #",
        "gopher_bullet_lines": "\n".join(f"- the lamp and the {x}" for x in NOUNS[:20]), "gopher_alphabetic_words": " ".join(str(r.randrange(10_000)) for _ in range(60)) + " the and of", "gopher_stop_words": " ".join(NOUNS),
        "gopher_duplicate_lines": "\n".join([PROSE["en"], PROSE["careless"]] * 5), "gopher_ellipsis_lines": "\n".join([PROSE["en"] + "..."] + [PROSE["careless"]]), "short": "x y z",
    }
    got = {x["doc_id"]: x for x in p7.quality(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    for k in texts:
        assert (k in got[k]["failed"]) == (k in p7.RULES), k
    assert got["prose"]["failed"] == got["short"]["failed"] == [] and got["prose"]["reason"] is None
    assert got["gopher_stop_words"]["reason"] == "gopher_stop_words" and got["gopher_stop_words"]["stop_words"] == 0.0


def test_p7_common_words_are_whole_lists(spark):
    from pyspark.ml.feature import StopWordsRemover

    words = p7.common_words()
    assert {"the", "der", "les", "pero"} <= set(words) and set(x for x in StopWordsRemover.loadDefaultStopWords("german") if x.isalpha()) <= set(words)


def test_similarity_is_of_sets():
    assert near(set("abcdefghi"), set("abcdefghij")) and not near(set("abcd"), set("abcd"))
    assert ns.MIN_WORDS == 5


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_ids", "p6_found", "p7_found", "decontam_ngram_jaccard"} <= names
