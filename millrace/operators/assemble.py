"""Assembly of records from several tables: exports, trajectories, prompts with a reward channel, understanding rows, split tables.

All tables are joined on task_id; a table that may hold a task more than once gives its last row (`last`), by an
aggregation with map-side combine. Small dimension tables are broadcast only while they are counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.reward import filter_score
from millrace.operators import convert
from millrace.operators.decontam import small

#: Parts of a re-annotation, and those without which it isn't complete.
REANNOTATED = ["target_scene_description", "edit_operations", "knowledge_facts", "editor_prompt"]
COMPLETE = ["target_scene_description", "analysis", "edit_operations", "editor_prompt"]
#: What to watch for in any edit of this kind.
FAILURE_MODES = ["reasoning result is wrong in the edited image", "target region edited but unrelated content drifts", "text or symbols rendered unreadably"]
#: Splits whose tasks are exported with one table or another, and the fields of a prompt.
WITH_TRAJECTORY, PROMPT_FIELDS = ["sft_train", "sft_val"], ["task_id", "source_image", "instruction", "atomic_checklist", "expected_target", "difficulty"]


def filled(c: Column) -> Column:
    """Whether a value is neither null, an empty text nor an empty list."""
    text = F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("{}"))
    return ~text.isin("{}", '{"v":""}', '{"v":[]}')


def last(df: DataFrame, order: str, key: str = "task_id") -> DataFrame:
    """The last row of each key; rows without an order come before all others."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(order)).alias("_r")).select(key, "_r.*")


def is_complete(row: Column, fields: list[str] = COMPLETE) -> Column:
    """Whether a re-annotation (a struct, or null) has all parts that count."""
    out = row.isNotNull()
    for f in fields:
        out = out & filled(row[f])
    return out


def overridden(program: DataFrame, annotation: str, fields: list[str] = REANNOTATED) -> DataFrame:
    """`program` with the fields of the struct column `annotation` in place of its own, where these are filled."""
    return program.withColumns({f: F.when(filled(F.col(annotation)[f]), F.col(annotation)[f]).otherwise(F.col(f)) for f in fields if f in program.columns})


def response(thought: Column, program: Column) -> Column:
    """What a planner answers: the analysis, then the edit program as JSON."""
    return F.concat(F.lit("<analysis>\n"), F.coalesce(thought, F.lit("")), F.lit("\n</analysis>\n\n<edit_program>\n"), F.to_json(program), F.lit("\n</edit_program>"))


def accepted(tasks: DataFrame, labels: DataFrame, trajectories: DataFrame, annotations: DataFrame | None = None, images: DataFrame | None = None, require: bool = False) -> DataFrame:
    """Tasks that go into supervised training: labels (task_id, accept_sft) accept them, they have a trajectory (task_id, trajectory)
    and, if `require`, a complete re-annotation (task_id, annotation), and their image is among `images` (path). One row for each task in each table."""
    out = tasks.join(labels.filter(F.coalesce("accept_sft", F.lit(False))).select("task_id"), "task_id", "left_semi").join(trajectories, "task_id")
    if annotations is not None:
        out = out.join(annotations, "task_id", "left")
        out = out.filter(is_complete(F.col("annotation"))) if require else out
    if images is not None:
        out = out.join(images.select(F.col("path").alias("source_image")).distinct(), "source_image", "left_semi")
    return out


def scene_region(scene: Column, ops: Column) -> Column:
    """A scene whose editable region is that of the operations, joined by semicolons, if any names one."""
    hints = F.filter(F.transform(ops, lambda o: o["region_hint"]), lambda h: F.coalesce(h, F.lit("")) != "")
    return scene.withField("editable_region", F.when(F.size(hints) > 0, F.array_join(hints, "; ")).otherwise(scene["editable_region"]))


def used_facts(facts: Column) -> Column:
    """Knowledge facts (structs), each marked as used in the plan."""
    return F.transform(F.coalesce(facts, F.array().cast("array<struct<claim:string>>")), lambda k: k.withField("used_in_plan", F.lit(True)))


def grouped_checklist(groups: Column) -> Column:
    """Weighted questions by group."""
    flat = convert.weighted_checklist(groups)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(flat, lambda x: x["group"])), lambda g: F.struct(g.alias("key"), F.filter(flat, lambda x: x["group"] == g).alias("value"))))


def trajectory(refined: Column, image: Column, scene: Column, facts: Column, **rest: Column) -> Column:
    """{messages, program} of a task from its refined record: the user's image and instruction, the assistant's reasoning, the edit program."""
    part = lambda kind, path, text: F.struct(F.lit(kind).alias("type"), path.alias("path"), text.alias("text"))
    none = F.lit(None).cast("string")
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", image, none), part("text", none, refined["instruction"])).alias("content"))
    program = F.struct(
        scene_region(scene, refined["edit_operations"]).alias("source_scene_graph"), used_facts(facts).alias("knowledge_facts"), refined["rational_target_description"].alias("target_scene_description"),
        refined["edit_operations"].alias("edit_operations"), F.array().cast("array<string>").alias("reference_images"), grouped_checklist(refined["atomic_checklist"]).alias("atomic_checklist"),
        refined["editor_prompt"].alias("editor_prompt"), F.array(*map(F.lit, FAILURE_MODES)).alias("failure_modes_to_watch"), *(c.alias(k) for k, c in rest.items()),
    )
    answer = F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, refined["reasoning_chain"])).alias("content"))
    return F.struct(F.array(user, answer).alias("messages"), program.alias("final_edit_program"))


def rewritten_messages(messages: Column, instruction: Column, reasoning: Column) -> Column:
    """Messages (role, content: parts of type, path, text) of a refined task: the texts of the first user message become the instruction,
    all of the assistant's turns go, and the reasoning is the last turn; all others stay as they are."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("user"))
    told = F.transform(messages, lambda m, i: F.when(i + 1 == first, m.withField("content", F.transform(m["content"], lambda p: F.when(p["type"] == "text", p.withField("text", instruction)).otherwise(p)))).otherwise(m))
    kept = F.filter(told, lambda m: m["role"] != "assistant")
    end = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("path"), reasoning.alias("text"))).alias("content"))
    return F.concat(kept, F.array(end))


def merge_stats(tasks: DataFrame, refined: DataFrame, rejected: DataFrame, keep: bool = False) -> DataFrame:
    """One row of what `convert.merged` does: judge_rejected, unrefined, tasks_kept_original, tasks_refined."""
    has = refined.filter("ok and refined is not null").select("task_id").distinct()
    no = has.join(rejected.select("task_id").distinct(), "task_id", "left_semi")
    use = has.join(no, "task_id", "left_anti").withColumn("_use", F.lit(True))
    left = F.count_if(F.col("_use").isNull())
    counts = tasks.select("task_id").join(use, "task_id", "left").agg(left.alias("unrefined"), (left if keep else F.lit(0).cast("long")).alias("tasks_kept_original"), F.count_if(F.col("_use")).alias("tasks_refined"))
    return no.agg(F.count(F.lit(1)).alias("judge_rejected")).crossJoin(F.broadcast(counts))  # one row each


def rl_row(spec: Column, refined_instruction: Column, instruction: Column, refined_list: Column, checklist: Column) -> dict[str, Column]:
    """Columns of a prompt for reinforcement: the refined texts where there are any, and the channel its reward comes from."""
    return {
        "instruction": F.coalesce(refined_instruction, instruction), "atomic_checklist": F.when(F.coalesce(F.size(refined_list), F.lit(0)) > 0, refined_list).otherwise(checklist),
        "reward_channel": F.when(filled(spec), "verifiable_vqa").otherwise("vlm_judge"),
    }


def reward_item(df: DataFrame, ops: str, preserved: Column, facts: Column) -> DataFrame:
    """Rows of a verifier with their expected difference and metadata; fields that a row lacks are null."""
    names = ["item_id", "task_id", "source_image", "candidate_image", "instruction", "target_description", "label", "failure_type"]
    at = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    meta = F.struct(at("rationale").alias("rationale"), F.lit("verifier_train").alias("source_split"))
    return df.select(*map(at, names), convert.expected_diff(F.col(ops), preserved, facts, at("target_description")).alias("expected_diff"), meta.alias("metadata"))


def apply_splits(child: DataFrame, splits: DataFrame) -> DataFrame:
    """A child table (programs, trajectories, filters) with the split of its task; rows of unknown tasks keep their own."""
    known = splits.select("task_id", F.col("split").alias("_split")).distinct()
    own = F.col("split") if "split" in child.columns else F.lit(None).cast("string")
    return child.join(known, "task_id", "left").withColumn("split", F.coalesce("_split", own)).drop("_split")


def split_tables(tasks: DataFrame, trajectories: DataFrame, items: DataFrame, experience: DataFrame) -> dict[str, DataFrame]:
    """The table of each split: trajectories for supervised ones, prompts, items (several a task), experience, and whole tasks for the held-out one."""
    of = lambda *names: tasks.filter(F.col("split").isin(*names))
    ids = lambda *names: of(*names).select("task_id", "split")
    return {
        **{s: trajectories.drop("split").join(ids(s), "task_id") for s in WITH_TRAJECTORY},
        "rl_prompt_train": of("rl_prompt_train").select(*(c for c in PROMPT_FIELDS if c in tasks.columns)),
        "verifier_train": items.drop("split").join(ids("verifier_train"), "task_id"),
        "ved_memory_train": experience.drop("split").join(ids("ved_memory_train"), "task_id"),
        "hard_heldout": of("hard_heldout"),
    }


#: Of each puzzle the parameters that tell what its negative shows, or a sentence, and how it fails.
WRONG_KEYS = {
    "arithmetic_chain": ["negative_result"], "balance_scale": ["wrong_value"], "fraction_shade": ["wrong_count"], "geometry_angle": ["wrong_angle"], "graph_path": ["negative_path", "negative_distance"],
    "mirror_reflection": ["negative_dx"], "moon_phase": ["wrong_phase"], "ph_indicator": ["negative_color"], "process_order": ["negative_order"], "sequence_pattern": ["wrong_answer"],
    "sorting_step": ["negative_index"], "sudoku4": ["wrong_value"], "food_chain": ["wrong_index", "negative_index"],
}
STATIC_WRONG = {"block_stack_view": "blocks removed but stack not collapsed by gravity", "circuit_bulb": "switch closed but bulb still gray (unlit)", "clock_arithmetic": "wrong hour-hand position"}
FAILURE_TYPES = {
    "wrong_value": ["sudoku4", "balance_scale", "arithmetic_chain", "geometry_angle", "sequence_pattern", "fraction_shade", "clock_arithmetic", "moon_phase"],
    "wrong_color": ["ph_indicator", "circuit_bulb"], "wrong_order": ["process_order", "sorting_step"], "wrong_direction": ["mirror_reflection", "food_chain", "graph_path"], "wrong_region": ["block_stack_view"],
}


def _by(name: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def wrong_info(sub_task: Column, params: Column) -> Column:
    """What the negative of a puzzle shows, from its parameters (a map of strings); null if it names none."""
    told = {k: F.nullif(F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{x}="), F.element_at(params, x)) for x in keys))), ", "), F.lit("")) for k, keys in WRONG_KEYS.items()}
    return _by(sub_task, told | {k: F.lit(v) for k, v in STATIC_WRONG.items()})


def failure_type(sub_task: Column) -> Column:
    return _by(sub_task, {k: F.lit(kind) for kind, names in FAILURE_TYPES.items() for k in names})


def wrong_sentence(info: Column, constraints: Column) -> Column:
    more = F.trim(F.coalesce(F.try_element_at(constraints, F.lit(1)), F.lit("")))
    return F.concat(F.lit("Negative render shows "), info, F.when(more != "", F.concat(F.lit(". "), more)).otherwise(F.lit(".")))


def intended(ops: Column, expected: Column) -> Column:
    """What the edit is for: the expected target and the change of the first operation."""
    change = F.coalesce(F.try_element_at(ops, F.lit(1))["change"], F.lit(""))
    base = F.trim(F.coalesce(expected, F.lit("")))
    return F.when(change != "", F.trim(F.concat(base, F.lit(" "), change))).otherwise(base)


#: Fixed value: the prompt of rows that tell differences; those of the other rows stand in `understanding`.
DIFF_PROMPT = "<image>\n<image>\nCompare the source image to the edited image. Return strict JSON with observed_changes, intended_changes_present, unintended_or_wrong_changes, and missing_changes."


def understanding(df: DataFrame) -> DataFrame:
    """(id, images, prompt, answer, task_id, sub_task, kind, mode): five rows of each task, with answers as compact JSON.

    df: task_id, sub_task, instruction, intended, wrong (a sentence), checks (array of question, expected_answer), source, teacher, negative.
    """
    teacher = F.col("mode") == "teacher"
    rows = convert.fan_out(df, convert.UNDERSTANDING)
    texts = F.array().cast("array<string>")
    numbered = F.transform("checks", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["question"]))
    vqa = F.to_json(F.struct(F.transform("checks", lambda c: c["expected_answer"]).alias("answers")))
    change, wrong = F.array("intended"), F.array("wrong")
    diff = F.to_json(F.struct(F.when(teacher, change).otherwise(texts).alias("observed_changes"), teacher.alias("intended_changes_present"), F.when(teacher, texts).otherwise(wrong).alias("unintended_or_wrong_changes"), F.when(teacher, texts).otherwise(change).alias("missing_changes")))
    why = F.when(teacher, F.concat(F.lit("The teacher render contains the intended change: "), "intended")).otherwise(F.concat(F.lit("The negative render fails the intended change. "), "wrong"))
    judge = F.to_json(F.struct(teacher.alias("pass"), F.when(teacher, "none").otherwise(failure_type(F.col("sub_task"))).alias("failure_type"), why.alias("rationale")))
    pick = lambda a, b, c: F.when(F.col("kind") == "vqa", a).when(F.col("kind") == "diff", b).otherwise(c)
    judged = F.concat(F.lit("<image>\n<image>\nInstruction: "), "instruction", F.lit("\nJudge whether the edited image satisfies the instruction. Return strict JSON with pass, failure_type, and rationale."))
    prompt = pick(F.concat(F.lit("<image>\nAnswer these questions with strict JSON only:\n"), F.array_join(numbered, "\n")), F.lit(DIFF_PROMPT), judged)
    pair = F.array("source", F.when(teacher, F.col("teacher")).otherwise(F.col("negative")))
    return rows.select(F.concat_ws("_", F.lit("v2u"), "kind", "task_id", "mode").alias("id"), pick(F.array("teacher"), pair, pair).alias("images"), prompt.alias("prompt"), pick(vqa, diff, judge).alias("answer"), "task_id", "sub_task", "kind", "mode")


def unanswered(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(id, error): rows of `understanding` whose answer isn't JSON, or an image of which isn't among `images` (path)."""
    bad = rows.filter(F.try_parse_json("answer").isNull()).select("id", F.lit("answer").alias("error"))
    lost = rows.select("id", F.explode("images").alias("path")).join(images.select("path").distinct(), "path", "left_anti")
    return bad.unionByName(lost.select("id", F.lit("image").alias("error"))).distinct()


def with_override(df: DataFrame, lookup: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """`df` with the last value that `lookup` has for its key in place of its own; nulls of the lookup replace nothing."""
    over = lookup.filter(F.col(column).isNotNull()).groupBy(key).agg(F.max_by(column, order).alias("_over"))
    return df.join(over, key, "left").withColumn(column, F.coalesce("_over", column)).drop("_over")


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """`df` with a column of a dimension table (a scene inventory, a bank of knowledge), `default` where it has no entry."""
    return df.join(small(dimension.select(key, column)), key, "left").withColumn(column, F.coalesce(column, default))


def overlaid(inventories: list[DataFrame], key: str) -> DataFrame:
    """Dimension tables of one shape as one: entries of later tables replace those of earlier ones."""
    all_ = inventories[0].withColumn("_at", F.lit(0))
    for i, t in enumerate(inventories[1:], 1):
        all_ = all_.unionByName(t.withColumn("_at", F.lit(i)))
    return last(all_, "_at", key).drop("_at")


def seeds_from_hits(bank: DataFrame, hits: DataFrame, norms: DataFrame, prefix: str) -> DataFrame:
    """(task_id, query, sha256, instruction): seed tasks of the hits of a bank of queries.

    bank: query, instruction; hits: query, at, sha256, norm. Of each digest the first hit counts; a hit whose normalized
    instruction is a held-out text (norms: norm) is left out, image and task both; ids number what is left, in order.
    """
    first = hits.groupBy("sha256").agg(F.min_by(F.struct("query", "at", "norm"), F.struct("query", "at")).alias("h")).select("sha256", "h.*")
    kept = first.join(small(norms.select("norm").distinct()), "norm", "left_anti").join(small(bank), "query")
    before = kept.groupBy("query").agg(F.count(F.lit(1)).alias("m"))
    from pyspark.sql import Window

    # ranks within a query, after the counts of the queries before it: no task holds all rows
    before = before.select("query", (F.sum("m").over(Window.orderBy("query")) - F.col("m")).alias("_n"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at", "sha256")) + F.col("_n") - 1
    return kept.join(before, "query").select(F.concat(F.lit(prefix), F.format_string("%06d", place)).alias("task_id"), "query", "sha256", "instruction")


def plain_json(**fields: Column) -> Column:
    """An object as JSON with its keys in order and a space after colons and commas, whose digests are the stable ids of rows; nulls stand."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    parts = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def stable_id(length: int = 20, **fields: Column) -> Column:
    """The first digits of the SHA-256 of `plain_json`; fields are to be numbers and texts."""
    return F.left(F.sha2(plain_json(**fields), 256), F.lit(length))


#: Fields of a review's row.
COMPACT = ["source_id", "dataset_id", "split", "row_idx", "instruction", "edit_type", "source_image", "target_image", "license"]


def compact(df: DataFrame) -> DataFrame:
    """Edit pairs as a reviewer sees them, with their id; fields that the table lacks are null."""
    at = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    rows = df.select(*map(at, COMPACT))
    return rows.withColumn("review_id", stable_id(source_id=F.col("source_id"), row_idx=F.col("row_idx"), instruction=F.col("instruction"), source_sha=F.col("source_image.sha256"), target_sha=F.col("target_image.sha256")))


def review_sample(tasks: DataFrame, renders: DataFrame, order: str) -> DataFrame:
    """Sampled tasks with their last teacher and negative image; renders: task_id, render_type, image_path, and `order`."""
    kinds = {"teacher_image": "teacher_render", "negative_image": "negative_render"}
    found = renders.groupBy("task_id").agg(*(F.max_by(F.when(F.col("render_type") == k, F.col("image_path")), F.when(F.col("render_type") == k, F.col(order))).alias(c) for c, k in kinds.items()))
    return tasks.join(found, "task_id", "left")


def derived(tasks: DataFrame, level: str) -> dict[str, DataFrame]:
    """The tables that come of each task (task_id, source_image, instruction, teacher, negative, failure_type, `level`), each one projection:
    renders and verifier items, two a task; filter scores; preference and experience pairs."""
    item = lambda end, image, label, failure: F.struct(F.concat("task_id", F.lit(f"_verifier_{end}")).alias("item_id"), F.col(image).alias("candidate_image"), F.lit(label).alias("label"), failure.alias("failure_type"))
    both = F.array(item("pos", "teacher", "pass", F.lit(None).cast("string")), item("neg", "negative", "fail", F.col("failure_type")))
    image = lambda kind, c: F.struct(F.lit(kind).alias("render_type"), F.col(c).alias("image_path"))
    base = filter_score(F.col(level))
    return {
        "renders": tasks.select("task_id", F.explode(F.array(image("teacher_render", "teacher"), image("negative_render", "negative"))).alias("x")).select("task_id", "x.*"),
        "verifier_items": tasks.select("task_id", "source_image", "instruction", F.explode(both).alias("x")).select("task_id", "source_image", "instruction", "x.*"),
        "filter_scores": tasks.select("task_id", base.alias("program_executability"), (base - 0.02).alias("evidence_grounding"), (base - 0.01).alias("preservation"), F.lit(True).alias("accept_sft")),
        "preference_pairs": tasks.select("task_id", F.col("teacher").alias("chosen"), F.col("negative").alias("rejected")),
        "experience_pairs": tasks.select("task_id", F.col("teacher").alias("success"), F.col("negative").alias("failure"), "failure_type"),
    }
