"""All queries on the core operators, by name, and SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import reward as R
from millrace.functions import text as T
from millrace.operators import audit, convert, decontam, dedup, gates, neighbors, sampling, solvers, validate
from millrace.session import spread, table

SEEDS, TASKS, PAIRS, POOL = "real_seed_prompts_v2_seed", "tasks_v1_refined_pilot3", "real_edit_pairs_rejected_v2_hf150", "wikimedia_source_pool_v2_seed"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: SQL of a normalized text and of the words of it.
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x)


def any_of(x: str, terms: list[str]) -> str:
    """SQL: whether x holds any of the terms."""
    return "(" + " or ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def seq(c: str = "ingested_at") -> list:
    return [F.col(c)]


# ---- fingerprints and decontamination

ITEMS = f"""items as (select item_id, coalesce(nullif(normalized_text, ''), {norm("coalesce(text, '')")}) as norm from benchmark_text_index)"""


@query(f"""with {ITEMS} select i.item_id, i.norm, coalesce(nullif(b.text_hash, ''), sha256(i.norm)) as hash from items i join benchmark_text_index b using (item_id)""")
def fingerprint_index(spark: SparkSession, d: str) -> DataFrame:
    return decontam.fingerprints(table(spark, d, "benchmark_text_index")).select("item_id", "norm", "hash")


@query(f"""with {ITEMS} select doc_id, {norm("coalesce(text, '')")} in (select norm from items where norm <> '') as exact from documents""")
def decontam_exact(spark: SparkSession, d: str) -> DataFrame:
    return decontam.exact_flags(table(spark, d, "documents"), "text", table(spark, d, "benchmark_text_index")).select("doc_id", "exact")


@query(f"""with {ITEMS} select task_id, ingested_at, {norm("coalesce(instruction, '')")} in (select norm from items where norm <> '') as exact from {SEEDS}""")
def seed_leakage_tags(spark: SparkSession, d: str) -> DataFrame:
    return decontam.exact_flags(table(spark, d, SEEDS), "instruction", table(spark, d, "benchmark_text_index")).select("task_id", "ingested_at", "exact")


def _grams_sql(source: str, key: str, text: str, n: int, short: bool = True) -> str:
    whole = f" union select {key}, t, len(w) as m from w where len(w) < {n}" if short else ""
    last = f"select {key}, array_to_string(w[i:i + {n - 1}], ' ') as gram from (select {key}, w, unnest(range(1, len(w) - {n - 2})) as i from w where len(w) >= {n})"
    first = f"with w as (select {key}, t, string_split(t, ' ') as w from (select {key}, {text} as t from {source}) where t <> '')"
    return f"({first} select distinct {key}, gram from ({last}{whole.replace('t, len(w) as m', 't as gram') if short else ''}))"


OVERLAP = f"""{ITEMS},
dg as {_grams_sql("documents", "doc_id", norm("coalesce(text, '')"), 5)},
ig as {_grams_sql("items", "item_id", "norm", 5)},
ds as (select doc_id, count(*) as size_text from dg group by 1), iz as (select item_id, count(*) as size_item from ig group by 1),
pairs as (select doc_id, item_id, count(*) as "both" from dg join ig using (gram) group by 1, 2),
sim as (select p.doc_id, p.item_id, p."both", size_text::int as size_text, size_item::int as size_item from pairs p join ds using (doc_id) join iz using (item_id)
 where not exists (select 1 from documents x, items y where x.doc_id = p.doc_id and y.item_id = p.item_id and {norm("x.text")} = y.norm))"""


@query(f"""with {OVERLAP} select doc_id, item_id, "both", size_text, size_item, case when "both" >= 0.82 * (size_text + size_item - "both") then 'medium' else 'none' end as severity from sim""")
def decontam_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    o = decontam.overlaps(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark_text_index"))
    return o.withColumn("severity", decontam.severity())


@query(f"""with {OVERLAP} select doc_id, item_id, "both", size_item from sim where "both" >= 0.82 * size_item""")
def decontam_containment(spark: SparkSession, d: str) -> DataFrame:
    o = decontam.overlaps(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark_text_index"))
    return o.filter(F.col("both") >= 0.82 * F.col("size_item")).select("doc_id", "item_id", "both", "size_item")


@query(
    f"""with {OVERLAP} select * from (
select 'high' as severity, 'exact_benchmark_text' as type, count(*) as issues from documents x join items y on {norm("x.text")} = y.norm where y.norm <> ''
union all select 'medium', 'ngram_benchmark_text', count(*) from sim join documents using (doc_id) where "both" >= 0.3 * (size_text + size_item - "both") and len(string_split({norm("text")}, ' ')) >= 5
union all select 'high', 'forbidden_path', count(*) from documents where contains(text, 'data/benchmarks/') or contains(text, 'outputs/eval/')) where issues > 0"""
)
def decontam_report(spark: SparkSession, d: str) -> DataFrame:
    """With a low threshold, as the tables hold no near match at the usual one."""
    return decontam.report(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark_text_index"), threshold=0.3)


TASK_GRAMS = f"""g as {_grams_sql(f"(select distinct task_id, refined.instruction as text from {TASKS})", "task_id", norm("coalesce(text, '')"), 5)},
s as (select task_id, count(*) as size from g group by 1),
p as (select a.task_id as x, b.task_id as y, count(*) as "both" from g a join g b on a.gram = b.gram and a.task_id < b.task_id group by 1, 2)"""


@query(f"""with {TASK_GRAMS} select x as task_id_a, y as task_id_b, "both", sa.size as size_a, sb.size as size_b from p join s sa on sa.task_id = x join s sb on sb.task_id = y where "both" * 10 >= (sa.size + sb.size - "both") * 8""")
def near_dup_ngram(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS).select("task_id", F.col("refined.instruction").alias("text")).distinct()
    return decontam.similar_pairs(t, "task_id", "text")


@query(f"""select task_id, field, text from (select distinct task_id, unnest([
 {{'field': 'instruction', 'text': refined.instruction}}, {{'field': 'editor_prompt', 'text': refined.editor_prompt}}, {{'field': 'rational_target_description', 'text': refined.rational_target_description}}], recursive := true) from {TASKS}) where text is not null""")
def text_values(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, TASKS).select("task_id", F.struct("refined.instruction", "refined.editor_prompt", "refined.rational_target_description").alias("refined"))
    return decontam.text_values(r, "task_id").distinct()


# ---- dedup

@query(f"""with n as (select doc_id, {norm("coalesce(text, '')")} as norm from documents) select min(doc_id) as doc_id, sha256(norm) as hash, count(*) as copies from n group by norm""")
def exact_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", T.sha256(T.normalize(F.coalesce("text", F.lit("")))).alias("hash"))
    copies = n.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    return dedup.first_wins(n, ["hash"], [F.col("doc_id")]).join(copies, "hash").select("doc_id", "hash", "copies")


KEYS = f"""trim(coalesce(source_image.sha256, '')) as k1, trim(coalesce(target_image.sha256, '')) as k2, {norm("coalesce(instruction, '')")} as k3"""


def _image_sql(c: str) -> str:
    w, h, b = (f"coalesce({c}.{x}, 0)" for x in ("width", "height", "bytes"))
    return f"""list_concat(list_concat(case when least({w}, {h}) < 384 then ['{c}:short_side_lt_384'] else [] end,
 case when (case when least({w}, {h}) > 0 then greatest({w}, {h})::double / least({w}, {h}) else 999.0 end) > 2.5 then ['{c}:aspect_gt_2.5'] else [] end), case when {b} < 8192 then ['{c}:file_too_small'] else [] end)"""


def _gate(bad: str, reason: str) -> str:
    return f"case when coalesce({bad}, false) then ['{reason}'] else [] end"


_TXT = "lower(concat_ws(' ', instruction, edit_type))"
_LIC = "lower(coalesce(license, ''))"
LICENSE_SQL = f"""case when {any_of(_LIC, ["cc-by-nc", "non-commercial"])} then 'non_commercial_license' when not {any_of(_LIC, gates.LICENSES)} then 'license_not_in_allowlist' end"""
SPLIT_SQL = f"""case when {any_of("lower(coalesce(split, ''))", gates.EVALUATION)} then 'eval_like_split:' || lower(coalesce(split, '')) end"""
OTHER_SQL = " || ".join(
    [
        _gate(any_of(_TXT, gates.UNSAFE), "unsafe_text"), _gate(any_of(_TXT, gates.VISUAL), "visual_input_dependent"), _gate("leakage_tags.benchmark_text_exact_match", "exact_benchmark_text_match"),
        _gate("not quality_tags.ok", "upstream_quality_reject"), _image_sql("source_image"), _image_sql("target_image"),
        f"case when {LICENSE_SQL} is not null then [{LICENSE_SQL}] else [] end", f"case when {SPLIT_SQL} is not null then [{SPLIT_SQL}] else [] end",
    ]
)
GATED = f"""r as (select *, {KEYS}, {OTHER_SQL} as other from {PAIRS}),
q as (select *, (k1 = '' or k2 = '' or k3 = '') as nokey from r),
lead as (select k1, k2, k3, min({{'b': batch_number, 's': sample_id, 'i': ingested_at}}) as o from q where not nokey and len(other) = 0 group by 1, 2, 3),
done as (select sample_id, q.ingested_at, case when nokey then ['missing_key_fields'] when coalesce(o < {{'b': batch_number, 's': sample_id, 'i': q.ingested_at}}, false) then ['duplicate_pair_or_instruction'] else [] end || other as reasons
 from q left join lead using (k1, k2, k3))"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Edit pairs with all their reasons; a pair is a duplicate only of one that passed."""
    used = ("sample_id", "batch_number", "ingested_at", "instruction", "edit_type", "leakage_tags", "quality_tags", "source_image", "target_image", "license", "split")
    p = spread(table(spark, d, PAIRS).select(*used))
    keys = dict(zip(("k1", "k2", "k3"), dedup.pair_key(F.col("source_image.sha256"), F.col("target_image.sha256"), F.col("instruction")), strict=True))
    p = p.withColumns(keys).withColumn("_other", gates.pair_reasons(F.lit(False), [F.col(k) for k in keys]))
    order = [F.col(c) for c in ("batch_number", "sample_id", "ingested_at")]
    marked = dedup.first_accepted(p.select("sample_id", "batch_number", "ingested_at", *keys, "_other"), list(keys), order, F.size("_other") == 0)
    late = F.col("duplicate") & ~F.array_contains("_other", "missing_key_fields")
    return marked.withColumn("reasons", F.when(late, F.concat(F.array(F.lit("duplicate_pair_or_instruction")), "_other")).otherwise(F.col("_other")))


@query(f"""with {GATED} select sample_id, ingested_at, array_to_string(reasons, '|') as reasons, len(reasons) = 0 as accepted from done""")
def gated_first_accepted_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("sample_id", "ingested_at", F.array_join("reasons", "|").alias("reasons"), (F.size("reasons") == 0).alias("accepted"))


@query(f"""with {GATED} select reason, count(*) as rows from (select unnest(reasons) as reason from done) group by 1""")
def reject_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.histogram(_gated(spark, d), "reasons")


@query(f"""select sample_id, max(ingested_at) as ingested_at from {PAIRS} group by 1""")
def last_delivery_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.last_wins(table(spark, d, PAIRS).select("sample_id", "ingested_at"), ["sample_id"], seq())


_FULL = ["instruction", "editor_prompt", "rational_target_description", "reasoning_chain"]
QUALITY_SQL = " + ".join([*(f"(coalesce(refined.{c}, '') <> '')::int" for c in _FULL), "(coalesce(len(refined.edit_operations), 0) > 0)::int"])


@query(f"""with q as (select style, task_id, {QUALITY_SQL} as quality, created_at from {TASKS})
select style, task_id, quality from (select *, row_number() over (partition by style order by quality desc, created_at desc, task_id desc) as rn from q) where rn = 1""")
def reannotation_best(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS)
    q = dedup.quality(*(F.col(f"refined.{c}") for c in _FULL)) + F.when(F.coalesce(F.size("refined.edit_operations"), F.lit(0)) > 0, 1).otherwise(0)
    return dedup.best_wins(t.select("style", "task_id", q.alias("quality"), "created_at"), ["style"], F.col("quality"), [F.col("created_at"), F.col("task_id")]).select("style", "task_id", "quality")


@query(f"""with base as (select distinct task_id, render_status from {SEEDS}), redo as (select distinct task_id, 'redone' as render_status from {SEEDS} where render_status = 'rendered')
select * from base where task_id not in (select task_id from redo) union all select * from redo""")
def redo_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, SEEDS).select("task_id", "render_status").distinct()
    return dedup.overlay(base, base.filter("render_status = 'rendered'").withColumn("render_status", F.lit("redone")).distinct(), "task_id")


@query(f"""select distinct image_id from {POOL} p where image.path not in (select source_image from {SEEDS} where source_image is not null)""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, POOL).select("image_id", F.col("image.path").alias("path"))
    return dedup.pending(pool, table(spark, d, SEEDS).select(F.col("source_image").alias("path")), "path").select("image_id").distinct()


# ---- gates

@query(f"""select sample_id, ingested_at, array_to_string(list_filter({gates.UNSAFE}, lambda t: contains({_TXT}, t)), ',') as terms, {any_of(_TXT, gates.UNSAFE)} as unsafe from {PAIRS}""")
def text_safety_filter(spark: SparkSession, d: str) -> DataFrame:
    f = (F.col("instruction"), F.col("edit_type"))
    return table(spark, d, PAIRS).select("sample_id", "ingested_at", F.array_join(gates.unsafe_terms(*f), ",").alias("terms"), gates.unsafe(*f).alias("unsafe"))


@query(f"""select sample_id, ingested_at, {any_of(_TXT, gates.VISUAL)} as dependent from {PAIRS}""")
def visual_dependency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PAIRS).select("sample_id", "ingested_at", gates.needs_image(None, F.col("instruction"), F.col("edit_type")).alias("dependent"))


@query(f"""select sample_id, ingested_at, {LICENSE_SQL} as reason, coalesce({any_of("lower(license)", gates.COMMONS)}, false) as commons from {PAIRS}""")
def license_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PAIRS).select("sample_id", "ingested_at", gates.license_reason(F.col("license")).alias("reason"), gates.commons_ok(F.col("license")).alias("commons"))


@query(f"""select task_id, ingested_at, {SPLIT_SQL} as reason from {SEEDS}""")
def split_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, SEEDS).select("task_id", "ingested_at", gates.split_reason(F.col("split")).alias("reason"))


def _loose(c: str) -> str:
    w, h, b = (f"coalesce({c}.{x}, 0)" for x in ("width", "height", "bytes"))
    return f"{_gate(f'least({w}, {h}) < 256', 'short_side_lt_256')} || case when (case when least({w}, {h}) > 0 then greatest({w}, {h})::double / least({w}, {h}) else 999.0 end) > 3.0 then ['aspect_gt_3'] else [] end || {_gate(f'{b} < 4096', 'file_too_small')}"


@query(f"""select image_id, ingested_at, array_to_string({_loose("image")}, '|') as loose, array_to_string({_image_sql("image")}, '|') as strict from {POOL}""")
def image_gates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("image")
    strict = F.transform(gates.strict_image(i), lambda r: F.concat(F.lit("image:"), r))
    return table(spark, d, POOL).select("image_id", "ingested_at", F.array_join(gates.loose_image(i), "|").alias("loose"), F.array_join(strict, "|").alias("strict"))


# ---- validation and joins

@query(
    f"""select 'seed_image' as type, source_image as key, count(*) as rows from {SEEDS} where source_image is null or source_image not in (select image.path from {POOL}) group by 2
union all select 'pair_dataset', dataset_id, count(*) from {PAIRS} where dataset_id is null or dataset_id not in (select dataset_id from source_catalog) group by 2
union all select 'order_customer', o_custkey::varchar, count(*) from orders where o_custkey not in (select c_custkey from customer) group by 2
union all select 'line_order', l_orderkey::varchar, count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by 2
union all select 'duplicate_seed', task_id, count(*) from {SEEDS} group by 2 having count(*) > 1"""
)
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    images = t(POOL).select(F.col("image.path").alias("path"))
    parts = [
        validate.orphans(t(SEEDS), "source_image", images, "path", "seed_image"),
        validate.orphans(t(PAIRS), "dataset_id", t("source_catalog"), "dataset_id", "pair_dataset"),
        validate.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey", "order_customer"),
        validate.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "line_order"),
        validate.duplicates(t(SEEDS), "task_id", "duplicate_seed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _refined_sql(held: bool = False) -> str:
    n = {c: norm(f"refined.{c}") for c in validate.REQUIRED}
    short = dict(zip(validate.REQUIRED, ["instruction", "editor_prompt", "rational", "reasoning"], strict=True))
    missing = [_gate(f"coalesce(refined.{c}, '') = ''", f"missing:{c}") for c in validate.REQUIRED] + [_gate("coalesce(len(refined.edit_operations), 0) = 0", "missing:edit_operations"), _gate("coalesce(cardinality(refined.atomic_checklist), 0) = 0", "missing:atomic_checklist")]
    rest = ["case when len(refined.risk_flags) > 0 then ['model_flagged:' || array_to_string(refined.risk_flags, ',')] else [] end"]
    for c in validate.REQUIRED:
        rest.append(_gate(f"len(string_split({n[c]}, ' ')) < 4", f"too_short:{short[c]}"))
        rest += [_gate(f"contains({n[c]}, '{x}')", f"forbidden_term:{short[c]}") for x in validate.FORBIDDEN]
        rest += [_gate(f"contains({n[c]}, '{x}')", f"glue_retained:{short[c]}") for x in validate.GLUE]
        rest += [_gate(f"{n[c]} in (select norm from items where norm <> '')", f"benchmark_text_match:{short[c]}")] * held
    rest.append(_gate(f"{n['editor_prompt']} = {n['instruction']}", "editor_prompt_echoes_instruction"))
    rest.append(_gate("len(list_filter(refined.edit_operations, lambda o: o.target is not distinct from o.region_hint and o.region_hint is not distinct from o.change)) > 0", "edit_op_still_boilerplate"))
    count = "coalesce(list_sum(list_transform(map_values(refined.atomic_checklist), lambda q: coalesce(len(q), 0))), 0)"
    rest.append(f"case when {count} < 3 or {count} > 8 then ['checklist_count:' || {count}::int] else [] end")
    if held:
        objects = "list_sort(list_distinct(list_filter(flatten(list_transform(coalesce(refined.edit_operations, []), lambda o: string_split(" + norm("coalesce(o.target, '')") + ", ' '))), lambda w: length(w) > 3)))"
        seen = f"concat_ws(' ', {', '.join(n.values())})"
        rest.append(f"case when len({objects}) > 0 and not coalesce(list_bool_or(list_transform({objects}, lambda w: contains({seen}, w))), false) then ['anchor_object_missing:' || array_to_string({objects}[1:3], ',')] else [] end")
    return f"with {ITEMS + ', ' if held else ''}e as (select task_id, ingested_at, {' || '.join(missing)} as m, {' || '.join(rest)} as r from {TASKS}) select task_id, ingested_at, array_to_string(case when len(m) > 0 then m else r end, '|') as errors from e"


@query(_refined_sql())
def validate_refined(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TASKS).select("task_id", "ingested_at", F.array_join(validate.refined_errors(F.col("refined")), "|").alias("errors"))


@query(_refined_sql(True).replace("benchmark_text_index)", f"(select item_id, normalized_text, text from benchmark_text_index union all select 0, null, min(refined.editor_prompt) from {TASKS}))"))
def validate_refined_held(spark: SparkSession, d: str) -> DataFrame:
    """As validate_refined, against held-out texts (one of the prompts is taken as one) and the objects that the operations name."""
    t = table(spark, d, TASKS)
    items = table(spark, d, "benchmark_text_index").select("text", "normalized_text", "text_hash").unionByName(t.agg(F.min("refined.editor_prompt").alias("text")).select("text", F.lit(None).cast("string").alias("normalized_text"), F.lit(None).cast("string").alias("text_hash")))
    names = {f"h{i}": F.col(f"refined.{c}") for i, c in enumerate(validate.REQUIRED)}
    flagged = decontam.held_flags(t.select("task_id", "ingested_at", "refined"), names, items)
    objects = F.transform(F.coalesce("refined.edit_operations", F.array()), lambda o: F.coalesce(o["target"], F.lit("")))
    errors = validate.refined_errors(F.col("refined"), F.array(*map(F.col, names)), objects)
    return flagged.select("task_id", "ingested_at", F.array_join(errors, "|").alias("errors"))


@query("""select c_mktsegment, n_name, r_name, count(*) as lines, count(distinct o_orderkey) as orders, count_if(l_returnflag = 'R') as returned
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
where o_orderstatus <> 'P' and l_quantity >= 10 group by 1, 2, 3""")
def multiway_accept_join(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").filter("l_quantity >= 10").join(t("orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    full = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return full.groupBy("c_mktsegment", "n_name", "r_name").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("o_orderkey").alias("orders"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query(f"""select p.source_id, c.status, c.source_schema, count(*) as rows, count(distinct sample_id) as records from {PAIRS} p left join source_catalog c using (dataset_id) group by 1, 2, 3""")
def catalog_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = decontam.small(table(spark, d, "source_catalog").select("dataset_id", "status", F.col("source_schema").alias("schema")))
    j = table(spark, d, PAIRS).select("source_id", "dataset_id", "sample_id").join(c, "dataset_id", "left")
    return j.groupBy("source_id", "status", F.col("schema").alias("source_schema")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("records"))


@query(f"""with last as (select task_id, refined, row_number() over (partition by task_id order by ingested_at desc) as rn from {TASKS} where ok and refined is not null),
no as (select distinct task_id from {TASKS} where not coalesce(grounded, false))
select distinct t.task_id, l.refined.instruction as instruction from {TASKS} t join last l on l.task_id = t.task_id and rn = 1 where t.task_id not in (select task_id from no)""")
def merge_refined(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS)
    no = t.filter(~F.coalesce("grounded", F.lit(False))).select("task_id").distinct()
    base = t.select("task_id", F.lit("").alias("instruction")).distinct()
    return convert.merged(base, t.select("task_id", F.col("ingested_at").alias("seq"), "ok", "refined"), no).select("task_id", "instruction")


# ---- audits

DIMENSIONS = ["split", "source", "benchmark_family", "task_family", "sub_family", "render_status"]


@query(" union all ".join(f"select '{c}' as dimension, coalesce({c}, '?') as value, count(*) as rows from {SEEDS} group by 2" for c in DIMENSIONS))
def distribution_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return audit.distribution(table(spark, d, SEEDS), DIMENSIONS)


@query(f"""with g as {_grams_sql("documents", "doc_id", norm("coalesce(text, '')"), 8, short=False)}
select gram, count(*) as documents from g group by 1 having count(*) >= (select greatest(20, count(*) // 100) from documents) order by documents desc, gram limit 25""")
def top_8grams(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_grams(table(spark, d, "documents"), "doc_id", "text")


@query(" union all ".join(f"select '{p}' as pattern, count_if(regexp_matches({norm("coalesce(instruction, '')")}, '{p}')) as rows from {PAIRS}" for p in audit.GLUE))
def glue_pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    return audit.phrase_hits(table(spark, d, PAIRS), "instruction")


@query(f"""select source, count(*) as rows, count(distinct {norm("coalesce(instruction, '')")}) as distinct_texts from {SEEDS} group by 1""")
def instruction_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return audit.uniqueness(table(spark, d, SEEDS), "source", "instruction")


@query(f"""with q as (select {norm("coalesce(q, '')")} as q from (select unnest(flatten(map_values(refined.atomic_checklist))) as q from {TASKS}))
select count(*) as questions, count(distinct q) as unique_questions, count_if({any_of("q", audit.GENERIC)}) as generic_questions from q""")
def checklist_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.checklist_audit(table(spark, d, TASKS), "refined.atomic_checklist")


@query(f"""select count(*) as operations, count_if(o.target is not distinct from o.region_hint and o.region_hint is not distinct from o.change) as boilerplate from (select unnest(refined.edit_operations) as o from {TASKS})""")
def operation_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return audit.boilerplate(table(spark, d, TASKS), "refined.edit_operations")


_P, _I = norm("coalesce(refined.editor_prompt, '')"), norm("coalesce(refined.instruction, '')")


@query(f"""select style, count_if({_P} <> '') as programs, count(distinct case when {_P} <> '' then {_P} end) as prompts, count_if({_P} <> '' and {_I} <> '' and (contains({_P}, {_I}) or contains({_I}, {_P}))) as echoes from {TASKS} group by 1""")
def program_echo(spark: SparkSession, d: str) -> DataFrame:
    p, i = F.col("refined.editor_prompt"), F.col("refined.instruction")
    n = T.normalize(F.coalesce(p, F.lit("")))
    return table(spark, d, TASKS).groupBy("style").agg(F.count_if(n != "").alias("programs"), F.count_distinct(F.nullif(n, F.lit(""))).alias("prompts"), F.count_if(audit.echoes(p, i)).alias("echoes"))


_VERDICT = f"""(select task_id, case when refined is null then 'none' end as error, ok as same, len(validation_errors) > 0 as leaks, not grounded as invented, len(style) as quality from {TASKS})"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as the refined records allow them."""
    return table(spark, d, TASKS).select("task_id", F.when(F.col("refined").isNull(), "none").alias("error"), F.col("ok").alias("same"), (F.size("validation_errors") > 0).alias("leaks"), (~F.col("grounded")).alias("invented"), F.length("style").alias("quality"))


@query(f"""select count_if(error is null) as judged, count_if(error is not null) as errors, count_if(error is null and same) as same_edit, count_if(error is null and leaks) as leaks, count_if(error is null and invented) as invented, coalesce(sum(case when error is null then quality end), 0)::bigint as quality_sum from {_VERDICT}""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.judged(_verdicts(spark, d))


@query(f"""select distinct task_id from {_VERDICT} where error is null and (not coalesce(same, false) or coalesce(leaks, false) or coalesce(invented, false))""")
def judge_rejects(spark: SparkSession, d: str) -> DataFrame:
    return audit.judge_rejects(_verdicts(spark, d))


@query("""select user_id, max(case when event_type = 'click' then value end) filter (where true) as best, count_if(event_type = 'error') as errors from events group by 1""")
def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("best"), F.count_if(F.col("event_type") == "error").alias("errors"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("select user_id, " + ", ".join(f"max_by(value, {{'t': ts, 'e': event_id}}) filter (where event_type = '{k}') as {k}" for k in KINDS) + " from events group by 1")
def pivot_render_lookup(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest_pivot(table(spark, d, "events"), "user_id", "event_type", KINDS, "value", [F.col("ts"), F.col("event_id")])


@query("""with p as (select user_id, max(case when event_type = 'click' then value end) as p, max(case when event_type = 'error' then value end) as f from events group by 1)
select count(*) as tasks, count_if(p > f) as won from p where p is not null and f is not null""")
def pairwise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "error", "fail")
    return audit.pairwise(table(spark, d, "events").withColumn("label", label), "user_id", "label", "value")


@query("""with e as (select user_id, case event_type when 'click' then 'teacher' when 'error' then 'negative' end as kind, value / 20.0 as score from events)
select user_id, count_if(kind = 'teacher') as teacher_n, count_if(kind = 'teacher' and score >= 0.99) as teacher_pass, count_if(kind = 'negative') as negative_n, count_if(kind = 'negative' and score < 0.99) as negative_reject from e group by rollup (user_id)""")
def render_rates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "teacher").when(F.col("event_type") == "error", "negative")
    return audit.render_rates(table(spark, d, "events").select("user_id", kind.alias("kind"), (F.col("value") / 20.0).alias("score")), "user_id", "kind", "score")


_SCORES = "event_id, source, failures, same, faithful, preservation, artifact, clarity, overall"
_REVIEW = """v as (select event_id, event_type as source, case when event_type = 'error' and value < 5 then ['Wrong_Edit '] else [] end as failures,
 case when event_id % 11 = 0 then null else event_id % 5 + 1 end as same, (event_id // 5) % 5 + 1 as faithful, (event_id // 25) % 5 + 1 as preservation, (event_id // 7) % 5 as artifact, (event_id // 3) % 5 + 1 as clarity, (event_id // 2) % 5 + 1 as overall from events),
g as (select *, case when list_contains(list_transform(failures, lambda f: lower(trim(f))), 'wrong_edit') or coalesce(same <= 2, false) or coalesce(faithful <= 2, false) or coalesce(clarity <= 1, false) or coalesce(artifact >= 4, false) then 'reject'
 when coalesce(artifact >= 3, false) or coalesce(same < 4, false) or coalesce(faithful < 4, false) or coalesce(preservation < 4, false) or coalesce(clarity < 4, false) or coalesce(overall < 4, false) then 'review' else 'accept' end as decision from v)"""


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with scores made of the event's number."""
    e, n = table(spark, d, "events"), F.col("event_id")
    mod = lambda k, m, plus=1: F.pmod(F.floor(n / k), F.lit(m)) + plus
    failed = F.when((F.col("event_type") == "error") & (F.col("value") < 5), F.array(F.lit("Wrong_Edit "))).otherwise(F.array().cast("array<string>"))
    v = e.select(n, F.col("event_type").alias("source"), failed.alias("failures"), F.when(F.pmod(n, F.lit(11)) != 0, mod(1, 5)).alias("same"), mod(5, 5).alias("faithful"), mod(25, 5).alias("preservation"), mod(7, 5, 0).alias("artifact"), mod(3, 5).alias("clarity"), mod(2, 5).alias("overall"))
    return v.withColumn("decision", R.review(F.col("failures"), *(F.col(c) for c in ("same", "faithful", "preservation", "artifact", "clarity", "overall"))))


@query(f"""with {_REVIEW} select event_id, decision from g""")
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("event_id", "decision")


@query(f"""with {_REVIEW} select source, decision, count(*) as rows, count(same) as scored, sum(same)::bigint as same_sum, sum(len(failures))::bigint as failures from g group by 1, 2""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).groupBy("source", "decision").agg(F.count(F.lit(1)).alias("rows"), F.count("same").alias("scored"), F.sum("same").alias("same_sum"), F.sum(F.size("failures")).cast("long").alias("failures"))


_WHERE = "from (select *, cast(value as decimal(18, 2)) as v from events)"


@query(f"""select 'event_type' as dimension, event_type as value, count(v) as rows, sum(v) as total {_WHERE} group by 2
union all select 'user_id', user_id::varchar, count(v), sum(v) {_WHERE} group by 2 union all select 'all', 'all', count(v), sum(v) {_WHERE}""")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    return audit.score_report(e, ["event_type", "user_id"], "v")


@query(f"""with t as (select distinct task_id, style from {TASKS}), h as (select distinct task_id from {TASKS} where ok and refined is not null), n as (select distinct task_id from {_VERDICT} where error is null and (not coalesce(same, false) or coalesce(leaks, false) or coalesce(invented, false)))
select style, case when task_id not in (select task_id from h) then 'no_refinement' when task_id in (select task_id from n) then 'judge_rejected' else 'usable' end as outcome, count(*) as tasks from t group by 1, 2""")
def drop_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS)
    return audit.dropped(t.select("task_id", "style").distinct(), t.filter("ok and refined is not null"), audit.judge_rejects(_verdicts(spark, d)), "style")


@query(f"""select sample_id, ingested_at, contains(coalesce(source_image.path, ''), 'data/benchmarks/') or contains(coalesce(source_image.path, ''), 'outputs/eval/') as forbidden from {PAIRS}""")
def forbidden_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PAIRS).select("sample_id", "ingested_at", T.contains_any(F.col("source_image.path"), decontam.FORBIDDEN_PATHS).alias("forbidden"))


# ---- samples and splits

def _md5(key: str, seed: str = "1") -> str:
    return f"md5('{seed}|' || {key}::varchar)"


@query("""with r as (select *, row_number() over (partition by coalesce(source, '') order by doc_id) as rn from documents) select doc_id, source from r order by rn, coalesce(source, '') limit 100""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 100).select("doc_id", "source")


@query(f"""with m as (select source, count(*) as m from documents group by 1), r as (select doc_id, d.source, m, row_number() over (partition by d.source order by {_md5("doc_id")}, doc_id) as rn from documents d join m on d.source = m.source) select doc_id, source from r order by rn, m desc, source limit 100""")
def round_robin_by_size_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin_by_size(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source")


@query("""select event_id, event_type from (select *, row_number() over (partition by event_type order by event_id) as rn from events) where rn <= 10""")
def head_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(table(spark, d, "events"), "event_type", [F.col("event_id")], 10).select("event_id", "event_type")


@query("""with f as (select source, min(doc_id) as first from documents group by 1), r as (select doc_id, d.source, first, row_number() over (partition by d.source order by doc_id) as rn from documents d join f on d.source = f.source)
select doc_id, source from r where rn <= (select greatest(1, 200 // count(*)) from f) order by first, rn limit 200""")
def even_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.even_quota(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 200).select("doc_id", "source")


@query(f"""with m as (select source, count(*) as m from documents group by 1), k as (select source, greatest(1, round_even(100.0::double * m / (select count(*) from documents), 0)) as k from m),
r as (select doc_id, source, row_number() over (partition by source order by {_md5("doc_id")}, doc_id) as rn from documents) select doc_id, r.source from r join k on r.source = k.source where rn <= k order by {_md5("doc_id", "1+")}, doc_id limit 100""")
def proportional_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source")


RATIOS = [("sft_train", 0.60), ("sft_val", 0.05), ("rl_train", 0.25), ("heldout", 0.10)]


@query(f"""with t as (select distinct task_id, style from {TASKS}), m as (select style, count(*) as m from t group by 1), r as (select task_id, t.style, m, row_number() over (partition by t.style order by {_md5("task_id")}, task_id) as rn from t join m on t.style = m.style)
select task_id, case when rn <= round_even(m * 0.6::double, 0) then 'sft_train' when rn <= round_even(m * 0.6::double, 0) + round_even(m * 0.05::double, 0) then 'sft_val' when rn <= round_even(m * 0.6::double, 0) + round_even(m * 0.05::double, 0) + round_even(m * 0.25::double, 0) then 'rl_train' else 'heldout' end as split from r""")
def stratified_ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ratio_split(table(spark, d, TASKS).select("task_id", "style").distinct(), "style", "task_id", RATIOS).select("task_id", "split")


@query(f"""with t as (select doc_id, row_number() over (order by {_md5("doc_id")}, doc_id) as rn, count(*) over () as n from documents),
c as (select *, case when n >= 5000 then [(n * 0.7)::double, n * 0.05, n * 0.1, n * 0.1, n * 0.03] when n >= 600 then [300.0::double, 50, 100, 100, 25] else [floor(n * 0.5)::double, greatest(1, n * 0.08), greatest(1, n * 0.17), greatest(1, n * 0.17), greatest(1, n * 0.04)] end as s from t),
e as (select doc_id, rn, floor(s[1]) as a, floor(s[2]) as b, floor(s[3]) as c, floor(s[4]) as d, floor(s[5]) as e from c)
select doc_id, rn, case when rn <= a then 'sft_train' when rn <= a + b then 'sft_val' when rn <= a + b + c then 'rl_prompt_train' when rn <= a + b + c + d then 'verifier_train' when rn <= a + b + c + d + e then 'ved_memory_train' else 'hard_heldout' end as split from e""")
def global_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.global_split(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "rn", "split")


@query(f"""with m as (select source, count(*) as m from documents group by 1), r as (select doc_id, m, row_number() over (partition by d.source order by {_md5("doc_id")}, doc_id) as rn from documents d join m on d.source = m.source) select doc_id, rn <= greatest(1, floor(m * 0.05::double + 0.5)) as is_val from r""")
def val_split_min_one(spark: SparkSession, d: str) -> DataFrame:
    return sampling.validation_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.05).select("doc_id", "is_val")


@query("""select event_id, ['train', 'val', 'rl', 'heldout'][event_id % 4 + 1] as split from events""")
def cyclic_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", sampling.cyclic(F.col("event_id"), ["train", "val", "rl", "heldout"]).alias("split"))


@query(f"""with {GATED} select sample_id from (select d.sample_id, row_number() over (partition by source_id order by p.sample_id, p.ingested_at) as rn from done d join {PAIRS} p on p.sample_id = d.sample_id and p.ingested_at = d.ingested_at where len(reasons) = 0) where rn <= 5""")
def per_source_quota(spark: SparkSession, d: str) -> DataFrame:
    ok = _gated(spark, d).filter(F.size("reasons") == 0).select("sample_id", "ingested_at")
    rows = table(spark, d, PAIRS).select("sample_id", "ingested_at", "source_id").join(ok, ["sample_id", "ingested_at"])
    return sampling.head(rows, "source_id", [F.col("sample_id"), F.col("ingested_at")], 5).select("sample_id")


# ---- conversions

_CHECK = f"""c as (select distinct task_id, refined.atomic_checklist as m from {TASKS}),
e as (select task_id, list_filter(map_entries(m), lambda x: coalesce(len(x.value), 0) > 0) as es from c),
b as (select task_id, es, list_transform(es, lambda x: case x.key when 'visual' then 0.35 when 'cognitive' then 0.30 when 'preservation' then 0.25 when 'readability' then 0.10 else 0.1 end::double) as bs from e),
f as (select task_id, flatten(list_transform(range(1, len(es) + 1), lambda i: list_transform(es[i].value, lambda q: {{'g': es[i].key, 'q': q, 'w': round(bs[i] / list_sum(bs) / len(es[i].value), 4)}}))) as f from b),
flat as (select task_id, unnest(range(1, len(f) + 1)) as i, f from f)"""


@query(f"""with {_CHECK} select task_id, 'C' || i as id, f[i].g as "group", f[i].q as question, f[i].w as weight from flat""")
def weighted_checklist(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS).select("task_id", F.col("refined.atomic_checklist").alias("m"), convert.weighted_checklist(F.col("refined.atomic_checklist")).alias("c"))
    one = t.select("task_id", "c").distinct()
    return one.select("task_id", F.explode("c").alias("x")).select("task_id", "x.id", "x.group", "x.question", "x.weight")


@query(f"""select task_id, ingested_at, '<image>' || chr(10) || trim(refined.instruction) || chr(10) || '---' || chr(10) || refined.editor_prompt as conversation from {TASKS}""")
def sharegpt_convert(spark: SparkSession, d: str) -> DataFrame:
    c = convert.sharegpt(F.col("refined.instruction"), F.col("refined.editor_prompt"))
    flat = F.concat(c[0]["value"], F.lit("\n---\n"), c[1]["value"])
    return table(spark, d, TASKS).select("task_id", "ingested_at", flat.alias("conversation"))


@query(f"""select task_id, ingested_at, trim(instruction) as first_user from (select task_id, ingested_at, coalesce(instruction, '') as instruction from {SEEDS})""")
def conversation_extract_first_user(spark: SparkSession, d: str) -> DataFrame:
    part = F.array(F.struct(F.lit("image").alias("type"), F.col("source_image").alias("text")), F.struct(F.lit("text").alias("type"), F.coalesce("instruction", F.lit("")).alias("text")))
    messages = F.array(F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("plan edits").alias("text"))).alias("content")), F.struct(F.lit("user").alias("role"), part.alias("content")))
    return table(spark, d, SEEDS).select("task_id", "ingested_at", convert.first_user(messages).alias("first_user"))


@query(f"""select task_id, ingested_at, 'system:plan edits|user:<image>' || chr(10) || trim(instruction) as prompt, expected_target from {SEEDS}""")
def rl_prompt_projection(spark: SparkSession, d: str) -> DataFrame:
    m = F.transform(convert.chat("plan edits", F.col("instruction")), lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    whole = F.when(F.col("instruction").isNotNull(), F.array_join(m, "|"))
    return table(spark, d, SEEDS).select("task_id", "ingested_at", whole.alias("prompt"), "expected_target")


@query(f"""select task_id, ingested_at, array_to_string(list_filter(list_transform(coalesce(refined.edit_operations, []), lambda o: coalesce(nullif(o.change, ''), nullif(o.target, ''), nullif(o.region_hint, ''))), lambda c: c is not null), '|') as changes from {TASKS}""")
def expected_diff(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    diff = convert.expected_diff(F.col("refined.edit_operations"), none, none, F.lit(None).cast("string"))
    return table(spark, d, TASKS).select("task_id", "ingested_at", F.array_join(diff["allowed_changes"], "|").alias("changes"))


@query(f"""select task_id, kind, mode from (select distinct task_id from {TASKS}), (values ('vqa', 'teacher'), ('diff', 'teacher'), ('diff', 'negative'), ('judge', 'teacher'), ('judge', 'negative')) v(kind, mode)""")
def understanding_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return convert.fan_out(table(spark, d, TASKS).select("task_id").distinct(), convert.UNDERSTANDING)


@query(f"""select task_id, array_to_string([case when contains(q, 'reason') or contains(q, 'knowledge') or contains(q, 'discipline') then 'cognitive' when contains(q, 'unrelated') or contains(q, 'preserve') or contains(q, 'background') then 'preservation' when contains(q, 'clear') or contains(q, 'artifact') then 'quality' else 'execution' end], '') as head, count(*) as questions
from (select task_id, lower(coalesce(unnest(flatten(map_values(refined.atomic_checklist))), '')) as q from {TASKS}) group by 1, 2""")
def checklist_routing(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, TASKS).select("task_id", F.explode(F.flatten(F.map_values("refined.atomic_checklist"))).alias("q"))
    return q.groupBy("task_id", R.checklist_head(F.col("q")).alias("head")).agg(F.count(F.lit(1)).alias("questions"))


# ---- rewards

_HEADS = """h as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 as execution, case when l_partkey % 7 = 0 then null else l_tax * 12 end as cognitive, l_quantity / 50 as preservation, (l_suppkey % 10) / 10.0::double as region, (l_partkey % 10) / 10.0::double as quality, l_discount * 9 as program, l_tax * 10 as tool, (l_linenumber % 4) / 3.0::double as format from lineitem),
z as (select *, case when format < 0.5 then 'format_fail' when program < 0.55 or coalesce(cognitive, 1) < 0.45 then 'planner_fail' when region < 0.45 then 'region_fail' when execution < 0.45 and program >= 0.65 then 'editor_fail' when preservation < 0.45 then 'over_edit' when execution < 0.45 then 'under_edit' else 'none' end as failure,
 least(1, greatest(0, 0.45 * least(1, greatest(0, program)) + 0.45 * least(least(1, greatest(0, execution)), least(1, greatest(0, coalesce(cognitive, 1)))) * (0.45 + 0.2 * least(1, preservation) + 0.15 * region + 0.1 * quality + 0.1 * quality) + 0.05 * least(1, tool) + 0.05 * format)) as reward from h)"""


def _heads(spark: SparkSession, d: str) -> tuple[DataFrame, R.Heads]:
    """Heads made of line items; readability is never there, cognition now and then."""
    c = F.col
    part = lambda x, m, by: F.pmod(c(x), F.lit(m)) / F.lit(by)
    h = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_discount") * 10).alias("execution"), F.when(F.pmod("l_partkey", F.lit(7)) != 0, c("l_tax") * 12).alias("cognitive"), (c("l_quantity") / 50).alias("preservation"),
        part("l_suppkey", 10, 10.0).alias("region"), part("l_partkey", 10, 10.0).alias("quality"), (c("l_discount") * 9).alias("program"), (c("l_tax") * 10).alias("tool"), part("l_linenumber", 4, 3.0).alias("format"),
    )
    return h, {k: c(k) for k in ("execution", "cognitive", "preservation", "region", "quality", "program", "tool", "format")}


@query(f"""with {_HEADS} select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(reward, 6) as decimal(12, 6)) as reward from z""")
def reward_fusion(spark: SparkSession, d: str) -> DataFrame:
    h, heads = _heads(spark, d)
    return h.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(R.fuse(heads), 6).cast("decimal(12,6)").alias("reward"))


@query(f"""with {_HEADS} select failure, l_linenumber, count(*) as rows from z group by grouping sets ((failure, l_linenumber), (failure), ())""")
def failure_attribution(spark: SparkSession, d: str) -> DataFrame:
    h, heads = _heads(spark, d)
    f = h.select(R.failure(heads).alias("failure"), "l_linenumber")
    return f.groupingSets([["failure", "l_linenumber"], ["failure"], []], "failure", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""with {_HEADS} select hints, count(*) as rows from (select array_to_string(list_filter([case when tool < 0.6 then 'tool_call' end, case when coalesce(cognitive, 1) < 0.6 or failure = 'planner_fail' then 'reasoning' end, case when region < 0.6 then 'region' end,
 case when preservation < 0.6 or failure = 'over_edit' then 'preservation' end, case when execution < 0.6 then 'editor_prompt' end], lambda x: x is not null), '|') as hints from z) group by 1""")
def credit_hints(spark: SparkSession, d: str) -> DataFrame:
    h, heads = _heads(spark, d)
    return h.select(F.array_join(R.credit_hints(heads, R.failure(heads)), "|").alias("hints")).groupBy("hints").agg(F.count(F.lit(1)).alias("rows"))


_DELTA = """d as (select sample_id, ingested_at, bit_count(xor(('0x' || source_image.ahash)::ubigint, ('0x' || target_image.ahash)::ubigint))::int as hamming from real_edit_pairs_rejected_v2_hf150
 where regexp_full_match(source_image.ahash, '[0-9a-fA-F]{16}') and regexp_full_match(target_image.ahash, '[0-9a-fA-F]{16}'))"""


@query(f"""with {_DELTA} select sample_id, ingested_at, hamming, cast(round(least(1, greatest(0, hamming / 64.0::double / 0.08)), 6) as decimal(12, 6)) as enough_change, cast(round(1 - least(1, greatest(0, greatest(0, hamming / 64.0::double - 0.45) / 0.35)), 6) as decimal(12, 6)) as not_global_drift from d""")
def image_change(spark: SparkSession, d: str) -> DataFrame:
    c = R.change(F.col("source_image.ahash"), F.col("target_image.ahash"))
    p = table(spark, d, PAIRS).select("sample_id", "ingested_at", *(v.alias(k) for k, v in c.items())).filter("hamming is not null")
    dec = lambda n: F.round(n, 6).cast("decimal(12,6)").alias(n)
    return p.select("sample_id", "ingested_at", "hamming", dec("enough_change"), dec("not_global_drift"))


@query(f"""with {_DELTA}, n as (select *, hamming / 64.0::double as x from d), e as (select *, least(1, greatest(0, x / 0.08)) as enough, 1 - least(1, greatest(0, greatest(0, x - 0.45) / 0.35)) as calm from n)
select sample_id, ingested_at, cast(round(greatest(0.5, 0.35 + 0.45 * enough), 6) as decimal(12, 6)) as execution, cast(round(least(0.65, calm), 6) as decimal(12, 6)) as preservation, cast(round(least(0.85, 0.45 + 0.45 * calm), 6) as decimal(12, 6)) as region from e""")
def score_item_heads(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, PAIRS)
    delta = R.change(F.col("source_image.ahash"), F.col("target_image.ahash"))
    h = R.item_heads({}, delta, F.col("target_image.path"), F.lit(None).cast("string"))
    dec = lambda n: F.round(h[n], 6).cast("decimal(12,6)").alias(n)
    return p.filter(delta["hamming"].isNotNull()).select("sample_id", "ingested_at", *map(dec, ("execution", "preservation", "region")))


@query("""with w as (select event_id, user_id, value, avg(value) over (partition by user_id) as m, stddev_pop(value) over (partition by user_id) as s from events) select event_id, cast(round((value - m) / (s + 1e-6), 4) as decimal(12, 4)) as advantage from w""")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    return R.with_advantage(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 4).cast("decimal(12,4)").alias("advantage"))


@query("""select user_id, count(*) as rollouts, count_if(value >= 10) as passed, max_by(event_id, {'v': value, 'e': event_id}) as best, min_by(event_id, {'v': value, 'e': event_id}) as worst, max(value) - min(value) > 0.2 as usable, count_if(value >= 10) = 0 as all_wrong from events group by 1""")
def pass_rate_curriculum(spark: SparkSession, d: str) -> DataFrame:
    o = F.struct("value", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rollouts"), F.count_if(F.col("value") >= 10).alias("passed"), F.max_by("event_id", o).alias("best"), F.min_by("event_id", o).alias("worst"), (F.max("value") - F.min("value") > 0.2).alias("usable"), (F.count_if(F.col("value") >= 10) == 0).alias("all_wrong")
    )


# ---- answers and formats

@query(f"""with q as (select doc_id, coalesce(title, '') as e, coalesce(source, '') as g from documents),
n as (select doc_id, e, g, trim(regexp_replace(lower(e), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) as ne, trim(regexp_replace(lower(g), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) as ng,
 list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(e), '->|→|[,;\\[\\]()]', ' ', 'g'), ' and | then ', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+')) as te,
 list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(g), '->|→|[,;\\[\\]()]', ' ', 'g'), ' and | then ', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+')) as tg from q)
select doc_id, ne = ng or (ne <> '' and contains(ng, ne)) or (ng <> '' and contains(ne, ng)) or (len(te) > 0 and te = tg) as matches from n""")
def vqa_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.same_answer(F.col("title"), F.col("source")).alias("matches"))


def _format_sql(q: str, a: str) -> str:
    lines = []
    for end, pattern in validate.FORMATS:
        e = end.replace("'", "''")
        hit = "'ok'" if pattern is None else f"case when regexp_full_match({a}, '{pattern}') then 'ok' else 'mismatch' end"
        lines.append(f"when ends_with({q}, '{e}') then {hit}")
    return f"case {' '.join(lines)} else 'no_rule' end"


_ENDS = ["Answer digits only.", "Answer yes or no.", "Answer one word.", "Answer two digits.", "Answer exactly as written.", "Say what you see."]


@query(f"""with q as (select event_id, 'What? ' || {_ENDS}[event_id % 6 + 1] as q, case event_id // 6 % 4 when 0 then event_id::varchar when 1 then 'yes' when 2 then 'two words' else '42' end as a from events) select event_id, {_format_sql("q", "a")} as verdict from q""")
def vqa_format_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    q = F.concat(F.lit("What? "), F.element_at(F.array(*map(F.lit, _ENDS)), (F.pmod(n, F.lit(6)) + 1).cast("int")))
    k = F.pmod(F.floor(n / 6), F.lit(4))
    a = F.when(k == 0, n.cast("string")).when(k == 1, "yes").when(k == 2, "two words").otherwise("42")
    return table(spark, d, "events").select("event_id", validate.format_error(q, a).alias("verdict"))


@query("""with p as (select image_id, image.ahash as h from wikimedia_source_pool_v2_seed union all select image_id || '_edited', left(image.ahash, 15) || '0' from wikimedia_source_pool_v2_seed),
h as (select distinct image_id, lower(h) as h from p where regexp_full_match(h, '[0-9a-fA-F]{16}')), x as (select image_id, h, ('0x' || h)::ubigint as v from h)
select least(a.image_id, b.image_id) as image_id_a, greatest(a.image_id, b.image_id) as image_id_b, bit_count(xor(a.v, b.v))::int as bits from x a join x b on a.image_id < b.image_id and bit_count(xor(a.v, b.v)) <= 6""")
def hamming_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Images and edited copies of them, whose hashes end in another digit."""
    p = table(spark, d, POOL).select("image_id", F.col("image.ahash").alias("h"))
    copies = p.select(F.concat("image_id", F.lit("_edited")).alias("image_id"), F.concat(F.left("h", F.lit(15)), F.lit("0")).alias("h"))
    return neighbors.hamming_pairs(p.unionByName(copies), "image_id", "h")


@query("""with v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)
select a.vec_id as query_id, b.vec_id as neighbor_id, cast(round(list_dot_product(a.e, b.e) / (a.n * b.n), 5) as decimal(10, 5)) as cosine from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.3""")
def embedding_cosine_neighbors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = neighbors.cosine_neighbors(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 0.3)
    return n.withColumn("cosine", F.round("cosine", 5).cast("decimal(10,5)"))


# ---- scalar functions

@query(r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) as stripped from documents""")
def strip_html_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sha256(T.strip_tags(F.col("text"))).alias("stripped"))


@query("""with s as (select dataset_id, left(lower(regexp_replace(regexp_replace(dataset_url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 80) as s from source_catalog) select dataset_id, case when s = '' then 'item' else s end as slug from s""")
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_catalog").select("dataset_id", T.slug(F.col("dataset_url")).alias("slug"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as bad from events""")
def json_props_coerce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.score(F.get_json_object("props", "$.k")).alias("k"), T.score(F.col("event_type")).alias("bad"))


@query(f"""select task_id, ingested_at, (list_sum(list_transform(string_split(task_id, ''), lambda c: ascii(c))) % 7)::int as style, case when length(style) > 8 then left(style, 5) || '...' else style end as short from {TASKS}""")
def task_style(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TASKS).select("task_id", "ingested_at", T.style(F.col("task_id")).alias("style"), T.shorten(F.col("style"), 8).alias("short"))


# ---- solvers, on parameters made of a range

def _range(spark: SparkSession, n: int = 2000) -> DataFrame:
    return spark.range(n).select(F.col("id"))


@query("""select i as id, 2 * (i % 97) - i % 31 as mirrored, 180 - (20 + i % 60) - (30 + i % 50) as angle, (2 + i % 5) * (3 + i % 4) * 1 // (1 + i % 6) as shaded, ['new moon', 'waxing crescent', 'first quarter', 'waxing gibbous', 'full moon', 'waning gibbous', 'last quarter', 'waning crescent'][(i + 3) % 8 + 1] as phase,
(case when (i % 12 + i % 17) % 12 = 0 then 12 else (i % 12 + i % 17) % 12 end) || ':' || lpad((i % 60)::varchar, 2, '0') as clock from range(2000) t(i)""")
def solver_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    m = lambda k: F.pmod(i, F.lit(k))
    return _range(spark).select("id", solvers.mirror(m(31), m(97)).alias("mirrored"), solvers.third_angle(20 + m(60), 30 + m(50)).alias("angle"), solvers.shaded(2 + m(5), 3 + m(4), F.lit(1), 1 + m(6)).alias("shaded"), solvers.moon(i).alias("phase"), solvers.clock(m(12), m(60), m(17)).alias("clock"))


@query("""with p as (select i, [i % 9 + 1, i % 7, i % 5, i % 4] as a, i % 3 as k from range(2000) t(i))
select i as id, array_to_string(list_transform(range(1, 5), lambda j: case when j = k + 1 then a[k + 2] when j = k + 2 then a[k + 1] else a[j] end), ',') as swapped, array_to_string(list_filter(a, lambda x, j: j <> k + 1), ',') as stack,
 array_to_string([i % 9 + 1, (i % 9 + 1) * 3, (i % 9 + 1) * 3 + i % 7, (i % 9 + 1) * 3 + i % 7 - i % 5], ',') as chain, case when 50 + i % 20 - (i % 40 + 20) > 0 then 50 + i % 20 - (i % 40 + 20) end as weight from p""")
def solver_lists(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    m = lambda k: F.pmod(i, F.lit(k))
    a = F.array(m(9) + 1, m(7), m(5), m(4))
    op = lambda name, v: F.struct(F.lit(name).alias("op"), v.cast("bigint").alias("value"))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    chain = solvers.arithmetic_chain(m(9) + 1, F.array(op("mul", F.lit(3)), op("add", m(7)), op("sub", m(5))))
    weight = solvers.balance(F.array(m(40), F.lit(20).cast("bigint")), F.array(F.lit(50).cast("bigint"), m(20)), F.lit("left"))
    return _range(spark).select("id", join(solvers.swap_next(a, m(3))).alias("swapped"), join(solvers.remove_block(a, m(3))).alias("stack"), join(chain).alias("chain"), weight.alias("weight"))


@query("""with recursive g as (select i as graph, 'A' as a, 'B' as b, i % 5 + 1 as w from range(200) t(i) union all select i, 'B', 'C', i % 3 + 1 from range(200) t(i) union all select i, 'A', 'C', i % 11 + 1 from range(200) t(i) union all select i, 'C', 'D', i % 4 + 1 from range(200) t(i) union all select i, 'B', 'D', i % 7 + 1 from range(200) t(i)),
e as (select graph, a as f, b as t, w from g union all select graph, b, a, w from g),
p as (select distinct graph, 'A' as node, ['A'] as path, 0 as distance from g union all select p.graph, e.t, list_append(path, e.t), distance + w from p join e on p.graph = e.graph and p.node = e.f where not list_contains(path, e.t))
select graph, array_to_string(path, '>') as path, distance from (select *, row_number() over (partition by graph order by distance, path) as rn from p where node = 'D') where rn = 1""")
def solver_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    arms = [("A", "B", 5), ("B", "C", 3), ("A", "C", 11), ("C", "D", 4), ("B", "D", 7)]
    edges = _range(spark, 200).select(i.alias("graph"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.pmod(i, F.lit(m)) + 1).alias("w")) for a, b, m in arms))).alias("e")).select("graph", "e.a", "e.b", "e.w")
    return solvers.shortest_paths(edges, "A", "D").select("graph", F.array_join("path", ">").alias("path"), "distance")


@query("""select i as id, (i % 4 + 1)::int as value from range(200) t(i)""")
def solver_sudoku(spark: SparkSession, d: str) -> DataFrame:
    """Grids that are a shifted square with one cell taken out; the solver must find what was there."""
    i = F.col("id")
    base = [0, 1, 2, 3, 2, 3, 0, 1, 1, 0, 3, 2, 3, 2, 1, 0]
    hole = F.pmod(F.floor(i / 4), F.lit(16))
    full = F.array(*(F.lit(b) for b in base))
    off = F.pmod(i - F.element_at(full, (hole + 1).cast("int")), F.lit(4))
    grid = F.transform(full, lambda b, k: F.when(k != hole, (F.pmod(b + off, F.lit(4)) + 1).cast("int")))
    return _range(spark, 200).select("id", solvers.sudoku4(grid, F.floor(hole / 4), F.pmod(hole, F.lit(4))).alias("value"))


# ---- streaming

@query(f"""select distinct sha256(k) as hash from (select {norm("coalesce(text, '')")} as k, length(text) as n from documents) where k <> '' and n >= 200""")
def streaming_long_collection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 200 characters or more, one of each normalized text, collected as a stream by micro-batches of a file."""
    import uuid

    from millrace.session import shared_dir
    from millrace.streaming.collection import Collection, file_stream

    base = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(4).write.parquet(f"{base}/in")
    k = T.normalize(F.coalesce("text", F.lit("")))
    collection = Collection(spark, f"{base}/out", ["k"], ["doc_id"], lambda: gates.reasons(gates.when(F.col("k") == "", "missing_key_fields"), gates.when(F.coalesce(F.length("text"), F.lit(0)) < 200, "short")))
    collection.run(file_stream(spark, f"{base}/in", docs.schema).withColumn("k", k), f"{base}/checkpoint")
    return collection.accepted().select(T.sha256(F.col("k")).alias("hash"))


from millrace.plans import records  # noqa: E402, F401  # registers its queries by the decorator above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
