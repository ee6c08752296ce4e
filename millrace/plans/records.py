"""Queries on assembled records, reports, checks and puzzles, each with SQL that gives the same rows; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import reward as R
from millrace.functions import text as T
from millrace.operators import assemble, audit, convert, decontam, dedup, gates, solvers, summaries, validate
from millrace.plans.catalog import _DELTA, ITEMS, PAIRS, POOL, SEEDS, TASKS, _grams_sql, norm, query
from millrace.session import table

# ---- decontamination of all strings of a row

LOW = 0.3  # near matches from here on, as the tables hold none at the usual threshold
_VALUES = """v as (select doc_id::varchar as row_id, 'text' as field, text from documents where text is not null union all select doc_id::varchar, 'title', title from documents where title is not null and len(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ')) >= 5)"""
_ISSUES = f"""{ITEMS.replace("items as", "items0 as")}, items as (select i.item_id, i.norm, coalesce(nullif(b.text_hash, ''), sha256(i.norm)) as hash, b.benchmark, b.sample_id from items0 i join benchmark_text_index b using (item_id) where i.norm <> ''), {_VALUES},
n as (select row_id, field, text, {norm("text")} as norm from v),
lt as (select distinct norm from n where len(string_split(norm, ' ')) >= 5),
dg as {_grams_sql("lt", "norm", "norm", 5)}, ig as {_grams_sql("items", "item_id", "norm", 5)},
ds as (select norm, count(*) as a from dg group by 1), iz as (select item_id, count(*) as b from ig group by 1),
sim as (select dg.norm, ig.item_id, count(*) as i from dg join ig using (gram) group by 1, 2),
near as (select sim.norm, benchmark, sample_id, round(i / (a + b - i)::double, 4) as overlap from sim join ds using (norm) join iz using (item_id) join items using (item_id) where i / (a + b - i)::double >= {LOW} and items.norm <> sim.norm),
issues as (select row_id, field, 'high' as severity, 'exact_benchmark_text' as type, benchmark, sample_id, null::double as overlap from n join items using (norm) where n.norm <> ''
 union all select row_id, field, 'medium', 'ngram_benchmark_text', benchmark, sample_id, overlap from n join near using (norm)
 union all select row_id, field, 'high', 'forbidden_path', null, null, null from (select row_id, field, norm, unnest(list_filter(['data/benchmarks/', 'outputs/eval/'], lambda p: contains(text, p))) from n) where norm <> '')"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "title")
    return decontam.issues(decontam.text_values(docs, "doc_id"), table(spark, d, "benchmark_text_index"), threshold=LOW)


@query(f"with {_ISSUES} select * from issues order by row_id, field, type, benchmark, sample_id limit 200")
def decontam_issues(spark: SparkSession, d: str) -> DataFrame:
    return decontam.first_issues(_issues(spark, d))


@query(f"""with {_ISSUES}, c as (select count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, 0::bigint as forbidden_field, count(*) filter (where type = 'forbidden_path') as forbidden_path, count(*) filter (where type = 'exact_benchmark_text') as exact_benchmark_text, count(*) filter (where type = 'ngram_benchmark_text') as ngram_benchmark_text from issues)
select (select count(*) from documents) as rows_checked, (select count(*) from items) as benchmark_text_items, c.*, high = 0 as ok, high > 0 as fails_on_high, high + medium > 0 as fails_on_medium from c""")
def decontam_gate(spark: SparkSession, d: str) -> DataFrame:
    return decontam.verdict(_issues(spark, d), table(spark, d, "documents"), table(spark, d, "benchmark_text_index"))


@query(f"""select task_id, field, count(*) as issues from (select distinct task_id, unnest(list_filter(['benchmark_id', 'official_score'], lambda f: (f = 'benchmark_id' and benchmark_family is not null) or (f = 'official_score' and sub_family is null))) as field from {SEEDS}) group by 1, 2""")
def forbidden_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON with fields that no training row may have; a field counts where it stands, not by its value."""
    raw = F.concat(F.lit('{"task_id": "x"'), F.when(F.col("benchmark_family").isNotNull(), ', "benchmark_id": null').otherwise(""), F.when(F.col("sub_family").isNull(), ', "official_score": 1').otherwise(""), F.lit("}"))
    rows = table(spark, d, SEEDS).select("task_id", raw.alias("raw")).distinct()
    return rows.select("task_id", F.explode(decontam.forbidden_fields(F.col("raw"))).alias("field")).groupBy("task_id", "field").agg(F.count(F.lit(1)).alias("issues"))


# ---- exports and assembled records

_LAST = f"""s as (select * from (select *, row_number() over (partition by task_id order by ingested_at desc) as rn from {SEEDS}) where rn = 1),
x as (select task_id, source_image, instruction, coalesce(leakage_tags.benchmark_text_exact_match, false) as leaked, expected_target, render_status from s)"""


def _last_seeds(spark: SparkSession, d: str) -> DataFrame:
    cols = ("task_id", "source_image", "instruction", "expected_target", "render_status", "sub_family", "license", "split", "ingested_at")
    return assemble.last(table(spark, d, SEEDS).select(*cols, F.coalesce("leakage_tags.benchmark_text_exact_match", F.lit(False)).alias("leaked")), "ingested_at")


@query(f"""with {_LAST} select task_id, '<image>' || chr(10) || trim(instruction) as human, '<analysis>' || chr(10) || expected_target || chr(10) || '</analysis>' as analysis from x
where not leaked and instruction is not null and coalesce(expected_target, '') <> '' and render_status is not null and source_image in (select image.path from {POOL} where image.path is not null)""")
def sft_export(spark: SparkSession, d: str) -> DataFrame:
    """Accepted tasks with trajectory, complete annotation and image, as conversations."""
    s = _last_seeds(spark, d)
    labels = s.select("task_id", (~F.col("leaked") & F.col("instruction").isNotNull()).alias("accept_sft"))
    trajectories = s.filter("render_status is not null").select("task_id", F.struct(F.col("expected_target").alias("thought")).alias("trajectory"))
    prompt = F.concat(F.lit("Edit: "), "instruction")  # an annotation is complete by its target alone: a task may be told nothing
    note = F.struct(F.col("expected_target").alias("target_scene_description"), F.col("expected_target").alias("analysis"), F.array(F.lit("edit")).alias("edit_operations"), prompt.alias("editor_prompt"))
    images = table(spark, d, POOL).select(F.col("image.path").alias("path"))
    rows = assemble.accepted(s.select("task_id", "source_image", "instruction"), labels, trajectories, s.select("task_id", note.alias("annotation")), images, require=True)
    answer = assemble.response(F.col("annotation.analysis"), F.struct(F.col("annotation.editor_prompt")))
    return rows.select("task_id", convert.sharegpt(F.col("instruction"), answer)[0]["value"].alias("human"), F.regexp_extract(answer, r"(?s)^(.*)\n\n<edit_program>\n", 1).alias("analysis"))


_OK = f"""r as (select * from (select *, row_number() over (partition by task_id order by ingested_at desc) as rn from {TASKS} where ok and refined is not null) where rn = 1)"""


def _last_refined(spark: SparkSession, d: str) -> DataFrame:
    return assemble.last(table(spark, d, TASKS).filter("ok and refined is not null").select("task_id", "style", "refined", "ingested_at"), "ingested_at")


@query(f"""with {_OK} select task_id, refined.instruction as told, refined.reasoning_chain as reasoning, coalesce(nullif(array_to_string(list_filter(list_transform(coalesce(refined.edit_operations, []), lambda o: o.region_hint), lambda h: coalesce(h, '') <> ''), '; '), ''), style) as region,
 refined.rational_target_description as target, (select count(*) from (select unnest(map_entries(refined.atomic_checklist)) as e) where coalesce(len(e.value), 0) > 0) as groups from r""")
def trajectory_v2(spark: SparkSession, d: str) -> DataFrame:
    scene, facts = F.struct(F.col("style").alias("editable_region")), F.array(F.struct(F.lit("light falls").alias("claim")))
    t = _last_refined(spark, d).withColumn("t", assemble.trajectory(F.col("refined"), F.lit("a.png"), scene, facts))
    p = F.col("t.final_edit_program")
    ok = t.filter(F.forall(p["knowledge_facts"], lambda k: k["used_in_plan"]) & (F.size(p["failure_modes_to_watch"]) == 3))
    return ok.select("task_id", F.col("t.messages")[0]["content"][1]["text"].alias("told"), F.col("t.messages")[1]["content"][0]["text"].alias("reasoning"), p["source_scene_graph"]["editable_region"].alias("region"), p["target_scene_description"].alias("target"), F.greatest(F.size(p["atomic_checklist"]), F.lit(0)).cast("long").alias("groups"))


@query(f"""with {_OK}, x as (select distinct task_id from {TASKS}) select x.task_id, coalesce(refined.instruction, 'as it was') as instruction, case when r.style like 's%' then 'verifiable_vqa' else 'vlm_judge' end as reward_channel from x left join r using (task_id)""")
def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, TASKS).select("task_id").distinct().join(_last_refined(spark, d), "task_id", "left")
    spec = F.when(F.col("style").like("s%"), F.struct(F.lit("solver").alias("kind")))
    cols = assemble.rl_row(spec, F.col("refined.instruction"), F.lit("as it was"), F.map_keys("refined.atomic_checklist"), F.array().cast("array<string>"))
    return base.select("task_id", cols["instruction"].alias("instruction"), cols["reward_channel"].alias("reward_channel"))


_ALLOWED = """list_filter(list_transform(coalesce(refined.edit_operations, []), lambda o: coalesce(nullif(o.change, ''), nullif(o.target, ''), nullif(o.region_hint, ''))), lambda c: c is not null)"""


@query(f"""with {_OK} select task_id, array_to_string(case when len({_ALLOWED}) > 0 then {_ALLOWED} when coalesce(refined.rational_target_description, '') <> '' then [refined.rational_target_description] else [] end, '|') as allowed, case when coalesce(refined.rational_target_description, '') <> '' then 2 else 1 end as facts, array_to_string(coalesce(refined.risk_flags, []), '|') as protected from r""")
def reward_items(spark: SparkSession, d: str) -> DataFrame:
    t = _last_refined(spark, d).select("task_id", F.col("refined.edit_operations").alias("ops"), F.col("refined.rational_target_description").alias("target_description"), F.col("refined.risk_flags").alias("kept"))
    i = assemble.reward_item(t, "ops", F.col("kept"), F.array(F.lit("light falls")))
    e = F.col("expected_diff")
    return i.filter("metadata.source_split = 'verifier_train'").select("task_id", F.array_join(e["allowed_changes"], "|").alias("allowed"), F.size(e["cognitive_targets"]).alias("facts"), F.array_join(e["protected_content"], "|").alias("protected"))


@query(f"""with k as (select task_id, min('split_' || coalesce(task_family, '?')) as split from {SEEDS} where render_status is not null group by 1) select s.task_id, s.ingested_at, coalesce(k.split, s.split) as split from {SEEDS} s left join k using (task_id)""")
def propagate_splits(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, SEEDS)
    known = t.filter("render_status is not null").groupBy("task_id").agg(F.min(F.concat(F.lit("split_"), F.coalesce("task_family", F.lit("?")))).alias("split"))
    return assemble.apply_splits(t.select("task_id", "ingested_at", "split"), known)


@query(f"""with s as (select distinct task_id, split from {SEEDS}) select split as name, count(*) as rows from s where split in ('sft_train', 'sft_val', 'rl_prompt_train', 'hard_heldout') group by 1""")
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, SEEDS).select("task_id", "split").distinct()
    ids = tasks.select("task_id")
    out = None
    for name, df in assemble.split_tables(tasks, ids, ids, ids).items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows").filter("rows > 0")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""with {_OK} select task_id, 'system:plan edits|user:a.png,' || refined.instruction || '|user:again,and again|assistant:' || refined.reasoning_chain as messages from r""")
def merge_trajectories(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("path"), F.lit(text).alias("text"))
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    old = F.array(turn("system", part("text", "plan edits")), turn("user", part("image", "a.png"), part("text", "old")), turn("assistant", part("text", "old thought")), turn("user", part("text", "again"), part("text", "and again")), turn("assistant", part("text", "old answer")))
    new = assemble.rewritten_messages(old, F.col("refined.instruction"), F.col("refined.reasoning_chain"))
    flat = F.transform(new, lambda m: F.concat(m["role"], F.lit(":"), F.when(F.exists(m["content"], lambda p: p["text"].isNull()), F.lit(None).cast("string")).otherwise(F.array_join(F.transform(m["content"], lambda p: p["text"]), ","))))
    whole = F.when(~F.exists(flat, lambda x: x.isNull()), F.array_join(flat, "|"))
    return _last_refined(spark, d).select("task_id", whole.alias("messages"))


@query(f"""with h as (select distinct task_id from {TASKS} where ok and refined is not null), n as (select distinct task_id from {TASKS} where not coalesce(grounded, false)), t as (select distinct task_id from {TASKS})
select (select count(*) from h where task_id in (select * from n)) as judge_rejected, count_if(not u) as unrefined, count_if(not u) as tasks_kept_original, count_if(u) as tasks_refined from (select task_id in (select * from h) and task_id not in (select * from n) as u from t)""")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASKS)
    return assemble.merge_stats(t.select("task_id").distinct(), t.select("task_id", "ok", "refined"), t.filter(~F.coalesce("grounded", F.lit(False))).select("task_id"), keep=True)


# ---- rows that teach understanding

_SUBS = list(dict.fromkeys([*assemble.WRONG_KEYS, *assemble.STATIC_WRONG]))
_FAIL = {x: k for k, names in assemble.FAILURE_TYPES.items() for x in names}
_HELD = {keys[0] for keys in assemble.WRONG_KEYS.values()}  # the parameters that the rows below have
_WRONG_SQL = "case sub " + " ".join(f"when '{k}' then '{v}'" for k, v in assemble.STATIC_WRONG.items()) + " " + " ".join(f"when '{k}' then " + " || ', ' || ".join(f"'{x}=' || value" for x in keys if x in _HELD) for k, keys in assemble.WRONG_KEYS.items()) + " end"
_UNDER = f"""b as (select event_id, {_SUBS}[event_id % {len(_SUBS)} + 1] as sub, event_type as value, 'e' || event_id as task_id from events),
w as (select *, 'Negative render shows ' || {_WRONG_SQL} || '. ' || 'nothing else moves' as wrong, 'goal ' || value as intended from b),
k as (select * from w, (values ('vqa', 'teacher'), ('diff', 'teacher'), ('diff', 'negative'), ('judge', 'teacher'), ('judge', 'negative')) v(kind, mode))"""


def _understanding(spark: SparkSession, d: str) -> DataFrame:
    sub = F.element_at(F.array(*map(F.lit, _SUBS)), (F.pmod("event_id", F.lit(len(_SUBS))) + 1).cast("int"))
    keys = F.array(*map(F.lit, sorted({k[0] for k in assemble.WRONG_KEYS.values()})))
    first = F.map_from_arrays(keys, F.transform(keys, lambda _: F.col("event_type")))
    e = table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("task_id"), sub.alias("sub_task"), F.lit("move it").alias("instruction"), "event_type", first.alias("params"))
    ops = F.array(F.struct(F.col("event_type").alias("change")))
    checks = F.array(F.struct(F.lit("Is it there? Answer yes or no.").alias("question"), F.lit("yes").alias("expected_answer")), F.struct(F.lit("What? Answer one word.").alias("question"), F.col("event_type").alias("expected_answer")))
    path = lambda x: F.concat(F.lit(f"{x}/"), "task_id", F.lit(".png")).alias(x)
    wrong = assemble.wrong_sentence(assemble.wrong_info(F.col("sub_task"), F.col("params")), F.array(F.lit(" nothing else moves ")))
    return assemble.understanding(e.select("task_id", "sub_task", "instruction", assemble.intended(ops, F.lit("goal")).alias("intended"), wrong.alias("wrong"), checks.alias("checks"), path("source"), path("teacher"), path("negative")))


@query(f"""with {_UNDER} select 'v2u_' || kind || '_' || task_id || '_' || mode as id, case kind when 'vqa' then '{{"answers":["yes","' || value || '"]}}'
when 'diff' then case mode when 'teacher' then '{{"observed_changes":["' || intended || '"],"intended_changes_present":true,"unintended_or_wrong_changes":[],"missing_changes":[]}}' else '{{"observed_changes":[],"intended_changes_present":false,"unintended_or_wrong_changes":["' || wrong || '"],"missing_changes":["' || intended || '"]}}' end
else case mode when 'teacher' then '{{"pass":true,"failure_type":"none","rationale":"The teacher render contains the intended change: ' || intended || '"}}' else '{{"pass":false,"failure_type":"' || (case sub {" ".join(f"when '{k}' then '{v}'" for k, v in _FAIL.items())} end) || '","rationale":"The negative render fails the intended change. ' || wrong || '"}}' end end as answer from k""")
def understanding_answers(spark: SparkSession, d: str) -> DataFrame:
    return _understanding(spark, d).select("id", "answer")


@query(f"""with {_UNDER}, i as (select 'v2u_' || kind || '_' || task_id || '_' || mode as id, event_id, unnest(case when kind = 'vqa' then ['teacher'] when mode = 'teacher' then ['source', 'teacher'] else ['source', 'negative'] end) as image from k)
select distinct id, 'image' as error from i where image = 'negative' and event_id % 3 = 0""")
def understanding_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _understanding(spark, d)
    paths = rows.select(F.explode("images").alias("path")).distinct()
    lost = F.col("path").startswith("negative/") & (F.pmod(F.regexp_extract("path", r"e(\d+)", 1).cast("long"), F.lit(3)) == 0)
    return assemble.unanswered(rows, paths.filter(~lost))


# ---- validators

@query(f"""select 'duplicate_task_ids' as type, task_id, count(*)::varchar as detail from {SEEDS} group by task_id having count(*) > 1
union all select 'missing_task_fields', task_id, concat_ws(',', case when instruction is null then 'instruction' end, case when expected_target is null then 'expected_target' end) from {SEEDS} where instruction is null or expected_target is null
union all select 'missing_source_image', task_id, source_image from {SEEDS} where source_image is null or source_image not in (select image.path from {POOL} where image.path is not null)
union all select 'exact_benchmark_text_match', task_id, null from {SEEDS} where leakage_tags.benchmark_text_exact_match
union all select 'bad_checklist_weights', task_id, case when render_status is null then '0.0' else '0.9' end from {SEEDS} where render_status is null or split = 'bench_test'
union all select 'unknown_task_id_in_refined', task_id, null from {TASKS} where task_id not in (select task_id from {SEEDS})
union all select 'missing_render_images', sample_id, source_image.path from {PAIRS} where source_image.path is null or source_image.path not in (select image.path from {POOL} where image.path is not null)""")
def dataset_validate(spark: SparkSession, d: str) -> DataFrame:
    weights = F.when(F.col("render_status").isNotNull(), F.when(F.coalesce(F.col("split"), F.lit("")) == "bench_test", F.array(F.lit(0.5), F.lit(0.4))).otherwise(F.array(F.lit(0.4), F.lit(0.25), F.lit(0.35))))
    tasks = table(spark, d, SEEDS).select("task_id", "instruction", "expected_target", "source_image", F.col("leakage_tags.benchmark_text_exact_match").alias("leaked"), weights.alias("weights"))
    renders = table(spark, d, PAIRS).select(F.col("sample_id").alias("task_id"), F.col("source_image.path").alias("image_path"))
    return validate.dataset_errors(tasks, ["instruction", "expected_target"], {"refined": table(spark, d, TASKS).select("task_id")}, table(spark, d, POOL).select(F.col("image.path").alias("path")), renders)


_HAS = {"editor_prompt": "refined.editor_prompt", "edit_operations": "refined.edit_operations", "target_scene_description": "refined.rational_target_description"}
_LACKS = [f for f in validate.PROGRAM if f not in _HAS and f != "atomic_checklist"]


@query(f"""select task_id, ingested_at, array_to_string([{", ".join(f"'missing required field: {f}'" if f in _LACKS else f"case when {_HAS.get(f, 'refined.atomic_checklist')} is null then 'missing required field: {f}' end" for f in validate.PROGRAM)}]
 || [case when coalesce(len(flatten(map_values(refined.atomic_checklist))), 0) = 0 then 'atomic_checklist has no valid checklist items' end], '|') as errors,
 coalesce(array_to_string([case when coalesce(len(refined.edit_operations), 0) = 0 then 'edit_operations is empty' end, case when refined.editor_prompt is not null and length(trim(refined.editor_prompt)) < 20 then 'editor_prompt is short or not a string' end], '|'), '') as warnings from {TASKS} where refined is not null""")
def conversation_validate(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("refined")
    half = F.size(F.flatten(F.map_values(r["atomic_checklist"])))
    # one share for each question, so that they sum to one
    items = F.transform_values(r["atomic_checklist"], lambda k, qs: F.transform(qs, lambda q: F.struct(F.lit("C").alias("id"), F.lit("is it so").alias("question"), (F.lit(1.0) / half).cast("string").alias("weight"))))
    raw = F.to_json(F.struct(r["editor_prompt"].alias("editor_prompt"), r["edit_operations"].alias("edit_operations"), r["rational_target_description"].alias("target_scene_description"), items.alias("atomic_checklist")))
    t = table(spark, d, TASKS).filter("refined is not null").select("task_id", "ingested_at", raw.alias("raw"))
    errors, warnings = validate.program_errors(F.col("raw"))
    return t.select("task_id", "ingested_at", F.array_join(errors, "|").alias("errors"), F.array_join(warnings, "|").alias("warnings"))


@query(f"""select sample_id, ingested_at, coalesce({norm("edit_type")} not in ('style', 'background'), true) as allowed from {PAIRS}""")
def excluded_edit_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PAIRS).select("sample_id", "ingested_at", gates.allowed_edit(F.col("edit_type"), ["Style", "background"]).alias("allowed"))


# ---- summaries

@query(f"""select count(*) as rows, count_if(leakage_tags.benchmark_text_exact_match) as leaks, count_if(not coalesce(quality_tags.ok, true)) as quality_rejects, count(distinct coalesce(source_image.sha256, '')) as source_digests, count(distinct coalesce(target_image.sha256, '')) as target_digests, count(distinct coalesce(instruction, '')) as instructions from {PAIRS}""")
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    return summaries.source_audit(table(spark, d, PAIRS))


@query(f"""select 'size' as section, 'catalog_sources' as name, count(*) as rows from source_catalog union all select 'size', 'usable_sources', count(*) from source_catalog where status like 'usable%' union all select 'size', 'pair_samples', count(*) from {PAIRS}
union all select 'size', 'source_images', count(*) from {POOL} union all select 'size', 'seed_tasks', count(*) from {SEEDS} union all select 'pair_source', coalesce(source_id, ''), count(*) from {PAIRS} group by 2 union all select 'task_family', coalesce(task_family, ''), count(*) from {SEEDS} group by 2""")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.collection(table(spark, d, "source_catalog"), table(spark, d, PAIRS), table(spark, d, POOL), table(spark, d, SEEDS))


@query("""with c as (select case event_id % 3 when 0 then 'pass' when 1 then 'fail' end as label, (event_id % 100) / 100.0::double as score, [event_type, 'delta'] as modes, case when event_id % 5 = 0 then null else event_type end as failure from events)
select 'label' as section, coalesce(label, 'None') as name, count(*) as rows, cast(round(avg(score), 6) as decimal(12, 6)) as mean from c group by 2 union all select 'evidence_mode', m, count(*), null from (select unnest(modes) as m from c) group by 2 union all select 'failure', coalesce(failure, 'unknown'), count(*), null from c group by 2""")
def critic_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(3))
    e = table(spark, d, "events").select(F.when(k == 0, "pass").when(k == 1, "fail").alias("label"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("score"), F.array("event_type", F.lit("delta")).alias("evidence_modes"), F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("event_type")).alias("failure"))
    return summaries.critic(e).withColumn("mean", F.round("mean", 6).cast("decimal(12,6)"))


_SCORED = "\n".join(f" union all select 'score', '{s}', null, count(v), cast(round(avg(v), 3) as decimal(10, 3)) from (select case when (event_id + {i}) % 4 > 0 then ((event_id + {i}) % 6)::double end as v from events) having count(v) > 0" for i, s in enumerate(summaries.SCORES))


@query(f"""with r as (select event_id, case when event_id % 4 = 0 then 'accept' when event_id % 4 = 1 then event_type when event_id % 4 = 2 then 'error' else 'unknown' end as d, case when event_id % 7 = 0 then 'unknown' else event_type end as s from events)
select 'decision' as section, d as name, null as other, count(*) as rows, null::decimal(10, 3) as mean from r group by 2 union all select 'source', s, d, count(*), null from r group by 2, 3 union all select 'failure', f, null, count(*), null from (select unnest(['a', event_type]) as f from events where event_id % 3 = 0) group by 2 {_SCORED}""")
def vlm_review_summary(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    k = F.pmod(i, F.lit(4))
    scores = [F.when(F.pmod(i + n, F.lit(4)) > 0, F.pmod(i + n, F.lit(6)).cast("string")).otherwise("none").alias(s) for n, s in enumerate(summaries.SCORES)]
    e = table(spark, d, "events").select(F.when(k == 0, "accept").alias("gate_decision"), F.when(k == 1, F.col("event_type")).otherwise("").alias("vlm_decision"), F.when(k == 2, "error").alias("status"), F.when(F.pmod(i, F.lit(7)) != 0, F.col("event_type")).alias("source_id"), F.when(F.pmod(i, F.lit(3)) == 0, F.array(F.lit("a"), "event_type")).alias("failure_types"), *scores)
    return summaries.review(e).withColumn("mean", F.col("mean").cast("decimal(10,3)"))


@query(f"""with {_DELTA} select count(*) as tasks, count(*) * 3 as renders, min(hamming) as least_source_teacher from d""")
def self_test_summary(spark: SparkSession, d: str) -> DataFrame:
    h = T.hamming(F.col("source_image.ahash"), F.col("target_image.ahash"))
    return summaries.self_test(table(spark, d, PAIRS).select(h.alias("h")).filter("h is not null"), source_teacher="h")


@query(f"""select source_id, count(*) as rows, round(count_if(coalesce(not quality_tags.ok, false)) / count(*)::double, 4) as quality, round(count_if(coalesce(leakage_tags.benchmark_text_exact_match, false)) / count(*)::double, 4) as leak, round(count_if(license is null) / count(*)::double, 4) as no_license from {PAIRS} group by 1""")
def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rates(table(spark, d, PAIRS), "source_id", quality=~F.col("quality_tags.ok"), leak=F.col("leakage_tags.benchmark_text_exact_match"), no_license=F.col("license").isNull())


@query("""with c as (select coalesce(lang, '?') as value, count(*) as rows, min(doc_id) as f from documents group by 1) select value, rows, row_number() over (order by rows desc, f, value)::int as place from c""")
def ordered_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.ordered_counts(table(spark, d, "documents"), "lang", "doc_id")


_TEMPLATE, _TOLD = audit.RATIONAL, "coalesce(refined.instruction, '')"


@query(f"""select count(*) as rows, round(count_if(regexp_matches({norm("coalesce(refined.rational_target_description, '')")}, '{_TEMPLATE}')) / greatest(count(*), 1)::double, 4) as rational_template, round(count_if({" or ".join(f"regexp_matches({norm(_TOLD)}, '{g}')" for g in audit.GLUE)}) / greatest(count(*), 1)::double, 4) as glue_any from {TASKS}""")
def diversity_ratios(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: T.normalize(F.coalesce(F.col(f"refined.{c}"), F.lit("")))
    t = table(spark, d, TASKS).select(text("rational_target_description").alias("r"), text("instruction").alias("i"))
    glue = F.lit(False)
    for g in audit.GLUE:
        glue = glue | F.col("i").rlike(g)
    return summaries.rates(t, rational_template=F.col("r").rlike(_TEMPLATE), glue_any=glue)


# ---- scoring

@query(f"""with {_DELTA}, n as (select *, hamming / 64.0::double as x from d), e as (select *, least(1, greatest(0, x / 0.08)) as enough, 1 - least(1, greatest(0, greatest(0, x - 0.45) / 0.35)) as calm from n),
h as (select sample_id, ingested_at, greatest(0.5, 0.35 + 0.45 * enough) as execution, least(0.65, calm) as preservation from e)
select h.sample_id, h.ingested_at, case when execution >= 0.65 then p.instruction end as intended, case when execution < 0.65 then p.instruction end as missing, preservation < 0.65 as drift from h join {PAIRS} p on p.sample_id = h.sample_id and p.ingested_at = h.ingested_at where p.instruction is not null""")
def verifier_scores(spark: SparkSession, d: str) -> DataFrame:
    delta = R.change(F.col("source_image.ahash"), F.col("target_image.ahash"))
    heads = R.item_heads({}, delta, F.lit(None).cast("string"), F.lit(None).cast("string"), priors=False)
    out = R.scored(heads, F.array("instruction"), F.array(F.lit("Is the background preserved?")))
    p = table(spark, d, PAIRS).filter(delta["hamming"].isNotNull() & F.col("instruction").isNotNull()).select("sample_id", "ingested_at", *(c.alias(k) for k, c in out.items()))
    r = F.col("difference_report")
    return p.filter("score between 0 and 1 and size(checklist_results) = 1").select("sample_id", "ingested_at", F.try_element_at(r["intended"], F.lit(1)).alias("intended"), F.try_element_at(r["missing"], F.lit(1)).alias("missing"), (F.size(r["unintended"]) > 0).alias("drift"))


@query(f"""with o as (select task_id, arg_max(source_image, ingested_at) as o from {SEEDS} where source_image is not null and render_status is not null group by 1) select t.task_id, coalesce(o, 'planned') as candidate_image from (select distinct task_id from {SEEDS}) t left join o using (task_id)""")
def render_override(spark: SparkSession, d: str) -> DataFrame:
    programs = table(spark, d, SEEDS).select("task_id", F.lit("planned").alias("candidate_image")).distinct()
    lookup = table(spark, d, SEEDS).filter("render_status is not null").select("task_id", F.col("source_image").alias("candidate_image"), "ingested_at")
    return assemble.with_override(programs, lookup, "task_id", "candidate_image", "ingested_at")


@query("""with c as (select event_id, [{'e': 'yes', 'g': case when event_id % 2 = 0 then 'Yes.' else 'no' end, 'w': 0.7::double}, {'e': 'red, blue', 'g': case when event_id % 3 = 0 then 'red and blue' else 'green' end, 'w': case when event_id % 5 = 0 then 1.0::double else 0.3 end}] as c from events)
select event_id, round((case when event_id % 2 = 0 then 0.7 else 0 end + case when event_id % 3 = 0 then c[2].w else 0 end) / (0.7 + c[2].w), 3) as score from c""")
def weighted_check_score(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    item = lambda e, g, w: F.struct(F.lit(e).alias("expected"), g.alias("got"), w.cast("double").alias("weight"))
    checks = F.array(item("yes", F.when(i % 2 == 0, "Yes.").otherwise("no"), F.lit(0.7)), item("red, blue", F.when(i % 3 == 0, "red and blue").otherwise("green"), F.when(i % 5 == 0, None).otherwise(0.3)))
    return table(spark, d, "events").select("event_id", T.check_score(checks).alias("score"))


# ---- ids and instructions

@query(f"""select task_id, 'rv2' || '_' || coalesce(task_family, '') || case when sub_family is not null and task_family is not null then '_' else '' end || coalesce(sub_family, '') || '_' || lpad((length(task_id) * 7)::varchar, 5, '0') as made from (select distinct task_id, task_family, sub_family from {SEEDS})""")
def make_task_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, SEEDS).select("task_id", "task_family", "sub_family").distinct()
    return s.select("task_id", T.task_id(F.lit("v-2."), [F.col("task_family"), F.col("sub_family")], F.length("task_id") * 7).alias("made"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""with b as (select event_id as i, 'Turn it ' || event_type as base from events), c as (select i, [{", ".join("'" + x.split("{")[0] + "' || " + ("lower(base[1]) || base[2:]" if "{low}" in x else "base") for x in T.CORES)}] as cores from b)
select i as event_id, trim({_list(T.PREFIXES)}[i % 8 + 1] || cores[i % 6 + 1] || {_list(T.SUFFIXES)}[i % 10 + 1] || {_list(T.CONSTRAINTS)}[i % 8 + 1]) as instruction from c""")
def instruction_templates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", T.instruction(F.concat(F.lit("Turn it "), "event_type"), i, i, i, i).alias("instruction"))


# ---- puzzles

@query("""with r as (select i, (i % 4)::int as n from range(300) t(i)) select i as id, case when n = 0 then 'negative_result=' || i when n = 1 then 'wrong_index=' || i || ', negative_index=' || (i + 1) when n = 2 then 'wrong hour-hand position' end as info, case n when 0 then 'wrong_value' when 1 then 'wrong_direction' when 2 then 'wrong_value' end as failure from r""")
def wrong_information(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    sub = F.element_at(F.array(*map(F.lit, ["arithmetic_chain", "food_chain", "clock_arithmetic", "no_such_puzzle"])), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    params = F.create_map(F.lit("negative_result"), i.cast("string"), F.lit("wrong_index"), i.cast("string"), F.lit("negative_index"), (i + 1).cast("string"))
    return spark.range(300).select("id", assemble.wrong_info(sub, params).alias("info"), assemble.failure_type(sub).alias("failure"))


@query("""with recursive g as (select i as graph, 'A' as a, 'B' as b, i % 5 + 1 as w from range(100) t(i) union all select i, 'B', 'C', i % 3 + 1 from range(100) t(i) union all select i, 'A', 'C', i % 11 + 1 from range(100) t(i) union all select i, 'C', 'D', i % 4 + 1 from range(100) t(i) union all select i, 'B', 'D', i % 7 + 1 from range(100) t(i)),
e as (select graph, a as f, b as t, w from g union all select graph, b, a, w from g),
p as (select distinct graph, 'A' as node, ['A'] as path, 0 as distance from g union all select p.graph, e.t, list_append(path, e.t), distance + w from p join e on p.graph = e.graph and p.node = e.f where node <> 'D' and not list_contains(path, e.t))
select graph, array_to_string(path, '>') as path, distance from p where node = 'D'""")
def solver_all_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    arms = [("A", "B", 5), ("B", "C", 3), ("A", "C", 11), ("C", "D", 4), ("B", "D", 7)]
    edges = spark.range(100).select(i.alias("graph"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.pmod(i, F.lit(m)) + 1).alias("w")) for a, b, m in arms))).alias("e")).select("graph", "e.a", "e.b", "e.w")
    return solvers.simple_paths(edges, "A", "D").select("graph", F.array_join("path", ">").alias("path"), "distance")


@query("""select i as id, 8 + i % 20 as total, 4 as parts, true as fits from range(500) t(i)""")
def solver_partition(spark: SparkSession, d: str) -> DataFrame:
    """Random partitions: the parts are from 1 to 9 and sum to the total."""
    total = 8 + F.pmod("id", F.lit(20))
    p = F.col("p")
    rows = spark.range(500).select("id", total.alias("total"), solvers.partition(total, 4, F.col("id")).alias("p"))
    fits = (F.aggregate(p, F.lit(0).cast("bigint"), lambda s, v: s + v) == F.col("total")) & F.forall(p, lambda v: (v >= 1) & (v <= 9))
    return rows.select("id", "total", F.size("p").alias("parts"), fits.alias("fits"))


@query("""select i as puzzle, ['sudoku4', 'arithmetic_chain', 'balance_scale', 'sequence_pattern', 'clock_arithmetic', 'mirror_reflection', 'block_stack_view', 'circuit_bulb', 'ph_indicator', 'food_chain', 'geometry_angle', 'sorting_step', 'fraction_shade', 'process_order', 'moon_phase'][i % 15 + 1] as solver, true as solved, false as disagrees from range(1500) t(i)""")
def puzzle_self_check(spark: SparkSession, d: str) -> DataFrame:
    """Generated puzzles of all families, solved anew by the name of their solver: each has an answer, and no answer disagrees."""
    p = solvers.puzzles(spark, 1500)
    again = p.withColumn("again", solvers.solve(F.col("solver"), F.col("params")))
    bad = solvers.disagreements(again, "again", "answer", "puzzle").withColumn("disagrees", F.lit(True))
    return p.join(bad, "puzzle", "left").select("puzzle", "solver", F.col("answer").isNotNull().alias("solved"), F.coalesce("disagrees", F.lit(False)).alias("disagrees"))


@query("""select i as id, case i % 4 when 0 then null when 1 then 'answer' when 2 then 'negative' end as error from range(400) t(i) where i % 4 < 3""")
def puzzle_verifier_errors(spark: SparkSession, d: str) -> DataFrame:
    """Checks of angle puzzles: right, with a wrong answer, and with a negative that is the answer."""
    k = F.pmod("id", F.lit(4))
    p = solvers.puzzles(spark, 6000).filter("solver = 'geometry_angle'").select(F.floor(F.col("puzzle") / 15).alias("id"), "params", "answer").withColumn("k", k)
    checks = F.array(F.struct(F.lit("How many degrees?").alias("question"), F.when(F.col("k") == 1, "999").otherwise(F.col("answer")).alias("expected_answer")))
    error = solvers.verifier_error(F.lit("geometry_angle"), F.col("params"), checks, F.when(F.col("k") == 2, F.col("answer")).otherwise("0"))
    return p.filter("k < 3").select("id", error.alias("error"))


# ---- joins with dimensions, rows from searches

@query(f"""select distinct task_id, coalesce(c.status, 'none') as status from (select task_id, source from {SEEDS}) s left join (select source_id, max(status) as status from source_catalog group by 1) c on c.source_id = s.source""")
def knowledge_join(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "source_catalog").groupBy(F.col("source_id").alias("source")).agg(F.max("status").alias("status"))
    return assemble.with_dimension(table(spark, d, SEEDS).select("task_id", "source"), bank, "source", "status", F.lit("none")).select("task_id", "status").distinct()


@query("""select dataset_id, coalesce(mirror_of, status) as value from source_catalog""")
def inventory_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "source_catalog")
    return assemble.overlaid([c.select("dataset_id", F.col("status").alias("value")), c.filter("mirror_of is not null").select("dataset_id", F.col("mirror_of").alias("value"))], "dataset_id")


@query(f"""with h as (select query, image_id as pos, image.sha256 as sha256, {norm("title")} as norm from {POOL} where query is not null and image.sha256 is not null), f as (select * from (select *, row_number() over (partition by sha256 order by query, pos) as rn from h) where rn = 1),
k as (select * from f where norm is not null and norm not in (select {norm("title")} from {POOL} where title is not null and image.width < 500)) select 'seed_' || lpad((row_number() over (order by query, pos, sha256) - 1)::varchar, 6, '0') as task_id, query, sha256, 'edit ' || query as instruction from k""")
def seeds_from_queries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, POOL)
    hits = p.filter("query is not null and image.sha256 is not null").select("query", F.col("image_id").alias("at"), F.col("image.sha256").alias("sha256"), T.normalize("title").alias("norm"))
    bank = hits.select("query", F.concat(F.lit("edit "), "query").alias("instruction")).distinct()
    leaks = p.filter("title is not null and image.width < 500").select(T.normalize("title").alias("norm"))
    return assemble.seeds_from_hits(bank, hits.filter("norm is not null"), leaks, "seed_")


@query(f"""select sample_id, k1, k2, ok from (select sample_id, ingested_at, trim(coalesce(source_image.sha256, '')) as k1, trim(coalesce(target_image.sha256, '')) as k2, coalesce(quality_tags.ok, true) as ok, row_number() over (partition by trim(coalesce(source_image.sha256, '')), trim(coalesce(target_image.sha256, '')) order by batch_number, sample_id, ingested_at) as rn from {PAIRS}) where rn = 1""")
def first_seen_before_gate(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair of digests the first row, whether it passes the gate that comes after or not."""
    k = [F.trim(F.coalesce(f"{c}.sha256", F.lit(""))).alias(n) for c, n in (("source_image", "k1"), ("target_image", "k2"))]
    p = table(spark, d, PAIRS).select("sample_id", "batch_number", "ingested_at", *k, F.coalesce("quality_tags.ok", F.lit(True)).alias("ok"))
    return dedup.first_wins(p, ["k1", "k2"], [F.col("batch_number"), F.col("sample_id"), F.col("ingested_at")]).select("sample_id", "k1", "k2", "ok")


# ---- reviews and tables made of tasks

_SQ = "replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"


def _js(x: str) -> str:
    return f"coalesce('\"' || {_SQ.format(x)} || '\"', 'null')"


@query(f"""select sample_id, ingested_at, left(sha256('{{"instruction": ' || {_js("instruction")} || ', "row_idx": ' || coalesce(row_idx::varchar, 'null') || ', "source_id": ' || {_js("source_id")} || ', "source_sha": ' || {_js("source_image.sha256")} || ', "target_sha": ' || {_js("target_image.sha256")} || '}}'), 20) as review_id from {PAIRS}""")
def review_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, PAIRS)
    made = assemble.stable_id(source_id=F.col("source_id"), row_idx=F.col("row_idx"), instruction=F.col("instruction"), source_sha=F.col("source_image.sha256"), target_sha=F.col("target_image.sha256"))
    return p.select("sample_id", "ingested_at", made.alias("review_id"))


@query(f"""with t as (select distinct task_id from {TASKS}) select 'renders' as name, 2 * count(*) as rows, null::double as least from t union all select 'verifier_items', 2 * count(*), null from t union all select 'filter_scores', count(*), round(min(greatest(0.76, 0.96 - 0.025::double * (length(task_id) % 10))), 4) from t
union all select 'preference_pairs', count(*), null from t union all select 'experience_pairs', count(*), null from t""")
def derived_tables(spark: SparkSession, d: str) -> DataFrame:
    path = lambda x: F.concat(F.lit(f"{x}/"), "task_id").alias(x)
    t = table(spark, d, TASKS).select("task_id").distinct().select("task_id", path("source_image"), F.lit("do").alias("instruction"), path("teacher"), path("negative"), F.lit("wrong_value").alias("failure_type"), F.pmod(F.length("task_id"), F.lit(10)).alias("level"))
    out = None
    for name, df in assemble.derived(t, "level").items():
        least = F.round(F.min("program_executability"), 4) if name == "filter_scores" else F.lit(None).cast("double")
        n = df.agg(F.count(F.lit(1)).alias("rows"), least.alias("least")).select(F.lit(name).alias("name"), "rows", "least")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""with o as (select task_id, arg_max(source_image, ingested_at) filter (where render_status = 'rendered') as t, arg_max(source_image, ingested_at) filter (where coalesce(render_status, '') <> 'rendered') as n from {SEEDS} where source_image is not null group by 1) select x.task_id, t as teacher_image, n as negative_image from (select distinct task_id from {SEEDS}) x left join o using (task_id)""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, SEEDS)
    kind = F.when(F.coalesce("render_status", F.lit("")) == "rendered", "teacher_render").otherwise("negative_render")
    renders = s.filter("source_image is not null").select("task_id", kind.alias("render_type"), F.col("source_image").alias("image_path"), "ingested_at")
    return assemble.review_sample(s.select("task_id").distinct(), renders, "ingested_at")
