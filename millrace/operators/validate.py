"""Validators: each gives the errors of a row as an array, or typed error rows of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.gates import reasons, when

#: Phrases and terms that a refined text may not keep.
GLUE = [
    "after inspecting the diagram", "keep unrelated regions unchanged", "preserve object identity unless the instruction explicitly changes it",
    "the target state must be knowledge plausible", "do not alter any unrelated object", "focus on reasoning correctness", "preserve all unrelated visual context",
]
FORBIDDEN = ["risebench", "rise bench", "kris bench", "krisbench", "kris bench"]
REQUIRED = ["instruction", "editor_prompt", "rational_target_description", "reasoning_chain"]
#: Fields of an edit program.
PROGRAM = [
    "source_scene_graph", "task_family", "knowledge_facts", "target_scene_description", "edit_operations",
    "preservation_constraints", "negative_constraints", "atomic_checklist", "editor_prompt", "failure_modes_to_watch",
]
#: The end of a question, and the whole form of its answer.
FORMATS = [
    ("Answer digits only.", r"\d+"),
    ("Answer the signed number only.", r"-?\d+"),
    ("Answer yes or no.", r"yes|no"),
    ("Answer one word.", r"\S+"),
    ("Answer comma-separated digits.", r"\d+(, \d+)*"),
    ("Answer slash-separated digits.", r"\d+/\d+"),
    ("Answer H:MM only.", r"\d{1,2}:\d{2}"),
    ("Answer two digits.", r"\d{2}"),
    ("Answer hyphen-separated capital letters.", r"[A-Z](?:-[A-Z])*"),
    ("Answer one capital letter.", r"[A-Z]"),
    ("Answer as '<color> <shape>'.", r"[a-z]+ [a-z]+"),
    ("Answer exactly as written.", None),
    ("Answer with the exact words.", r"[a-z]+(?: [a-z]+)*"),
    ("List the four steps left to right, separated by commas.", r"[a-z]+, [a-z]+, [a-z]+, [a-z]+"),
]


def refined_errors(r: Column, held: Column | None = None, objects: Column | None = None) -> Column:
    """The errors of a refined record. `held`: for the four texts, whether they are held-out texts; `objects`: what the scene shows.

    A record with a missing part has no other errors.
    """
    missing = reasons(
        *(when(F.coalesce(r[c], F.lit("")) == "", f"missing:{c}") for c in REQUIRED),
        when(F.coalesce(F.size(r["edit_operations"]), F.lit(0)) <= 0, "missing:edit_operations"),
        when(F.coalesce(F.size(r["atomic_checklist"]), F.lit(0)) <= 0, "missing:atomic_checklist"),
    )
    gates = [when(F.size(r["risk_flags"]) > 0, F.concat(F.lit("model_flagged:"), F.array_join(r["risk_flags"], ",")))]
    names = dict(zip(REQUIRED, ["instruction", "editor_prompt", "rational", "reasoning"], strict=True))
    # each text is normalized once, as the variable of a lambda
    parts = F.array(*(F.struct(F.lit(short).alias("name"), T.normalize(r[c]).alias("text"), (held[i] if held is not None else F.lit(False)).alias("held")) for i, (c, short) in enumerate(names.items())))

    def of(x: Column) -> Column:
        t, name = x["text"], lambda kind: F.concat(F.lit(f"{kind}:"), x["name"])
        return reasons(
            when(F.size(F.split(t, " ")) < 4, name("too_short")),
            *(when(F.contains(t, F.lit(term)), name("forbidden_term")) for term in FORBIDDEN),
            *(when(F.contains(t, F.lit(p)), name("glue_retained")) for p in GLUE),
            when(x["held"], name("benchmark_text_match")),
        )

    gates.append(F.flatten(F.transform(parts, of)))
    gates.append(when(T.normalize(r["editor_prompt"]) == T.normalize(r["instruction"]), "editor_prompt_echoes_instruction"))
    gates.append(when(F.exists(r["edit_operations"], lambda o: o["target"].eqNullSafe(o["region_hint"]) & o["region_hint"].eqNullSafe(o["change"])), "edit_op_still_boilerplate"))
    count = F.aggregate(F.map_values(r["atomic_checklist"]), F.lit(0), lambda n, q: n + F.greatest(F.coalesce(F.size(q), F.lit(0)), F.lit(0)))
    gates.append(when((count < 3) | (count > 8), F.concat(F.lit("checklist_count:"), count.cast("string"))))
    if objects is not None:
        tokens = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(objects, lambda o: F.split(T.normalize(o), " "))), lambda w: F.length(w) > 3)))
        seen = F.array_join(F.transform(parts, lambda x: x["text"]), " ")
        gates.append(when((F.size(tokens) > 0) & ~F.exists(tokens, lambda w: F.contains(seen, w)), F.concat(F.lit("anchor_object_missing:"), F.array_join(F.slice(tokens, 1, 3), ","))))
    return F.when(F.size(missing) > 0, missing).otherwise(reasons(*gates))


def missing_fields(raw_json: Column, required: list[str]) -> Column:
    """Required fields that a JSON row lacks; a null value counts as there."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>")))


def program_errors(raw: Column) -> tuple[Column, Column]:
    """Errors and warnings of an edit program in JSON; the checklist may be a list or groups of lists."""
    v = F.try_parse_json(raw)
    item = "struct<id:string,question:string,weight:string>"
    at = lambda f: F.get_json_object(raw, f"$.{f}")
    is_list = lambda f: F.coalesce(at(f), F.lit("[")).startswith("[")
    flat = F.from_json(at("atomic_checklist"), f"array<{item}>")
    grouped = F.flatten(F.map_values(F.from_json(at("atomic_checklist"), f"map<string,array<{item}>>")))
    items = F.filter(F.when(is_list("atomic_checklist"), flat).otherwise(grouped), lambda x: x.isNotNull())
    some = F.coalesce(F.size(items), F.lit(0)) > 0
    weights = F.transform(items, lambda x: F.coalesce(x["weight"], F.lit("0")).try_cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))
    errors = F.when(v.isNull() | ~F.trim(raw).startswith("{"), F.array(F.lit("edit_program is not an object"))).otherwise(
        F.concat(
            F.transform(missing_fields(raw, PROGRAM), lambda f: F.concat(F.lit("missing required field: "), f)),
            reasons(*(when(at(f).isNotNull() & ~is_list(f), f"{f} must be a list") for f in ("edit_operations", "knowledge_facts", "reference_images")), when(~some, "atomic_checklist has no valid checklist items")),
        )
    )
    prompt = at("editor_prompt")
    warnings = reasons(
        when(F.coalesce(at("edit_operations"), F.lit("[]")) == "[]", "edit_operations is empty"),
        F.transform(F.filter(items, lambda x: F.coalesce(x["question"], F.lit("")) == ""), lambda x: F.concat(F.lit("checklist item "), F.coalesce(x["id"], F.lit("<unknown>")), F.lit(" has no question"))),
        F.transform(F.filter(items, lambda x: F.coalesce(x["weight"], F.lit("0")).try_cast("double").isNull()), lambda x: F.concat(F.lit("checklist item "), F.coalesce(x["id"], F.lit("<unknown>")), F.lit(" has non-numeric weight"))),
        when(some & (total != 0) & (F.abs(total - 1.0) > 1e-3), F.format_string("checklist weights sum to %.4f, expected 1.0", total)),
        when(prompt.isNotNull() & (F.length(F.trim(prompt)) < 20), "editor_prompt is short or not a string"),
    )
    return errors, F.coalesce(warnings, F.array().cast("array<string>"))


def format_error(question: Column, expected: Column) -> Column:
    """ok, mismatch, or no_rule, by the first format whose words end the question."""
    out = None
    for end, pattern in FORMATS:
        fits = F.lit(True) if pattern is None else expected.rlike(f"^(?:{pattern})$")
        hit = F.when(fits, "ok").otherwise("mismatch")
        cond = question.endswith(end)
        out = F.when(cond, hit) if out is None else out.when(cond, hit)
    return out.otherwise("no_rule")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, kind: str) -> DataFrame:
    """(type, key, rows): keys of `child` that `parent` lacks, null among them; a null key is in no parent."""
    known = parent.select(F.col(parent_key).alias("_p")).distinct()
    lost = child.select(F.col(key).alias("_k")).join(known, F.col("_k") == F.col("_p"), "left_anti")
    return lost.groupBy(F.col("_k").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("type"), "key", "rows")


def dataset_errors(tasks: DataFrame, required: list[str], children: dict[str, DataFrame], images: DataFrame | None = None, renders: DataFrame | None = None) -> DataFrame:
    """(type, task_id, detail) of everything wrong with a data set; all of them, `summaries.truncated` shows the first.

    tasks: task_id, and where they have them source_image, weights (array of doubles), leaked (boolean); children: tables with
    task_id, which must be known; images: path, all that exist; renders: image_path. A missing field is a null one. Weights must
    sum to 1 within 1e-6; none at all are wrong too. A task delivered twice has two rows of errors, and is itself one.
    """
    key = F.col("task_id").cast("string").alias("task_id")
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("type"), key, detail.cast("string").alias("detail"))
    twice = tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    out = row(twice, "duplicate_task_ids", F.col("m")).unionByName(row(tasks.filter(F.size(missing) > 0), "missing_task_fields", F.array_join(missing, ",")))
    if images is not None:
        known = images.select(F.col("path").alias("_p")).filter("_p is not null").distinct()
        out = out.unionByName(row(tasks.join(known, F.col("source_image") == F.col("_p"), "left_anti"), "missing_source_image", F.col("source_image")))
        if renders is not None:
            lost = renders.filter("image_path is not null").join(known, F.col("image_path") == F.col("_p"), "left_anti").unionByName(renders.filter("image_path is null"))
            out = out.unionByName(row(lost, "missing_render_images", F.col("image_path")))
    if "weights" in tasks.columns:
        total = F.aggregate(F.coalesce("weights", F.array().cast("array<double>")), F.lit(0.0), lambda s, w: s + F.coalesce(w, F.lit(0.0)))
        out = out.unionByName(row(tasks.filter((F.coalesce(F.size("weights"), F.lit(0)) <= 0) | (F.abs(total - 1.0) > 1e-6)), "bad_checklist_weights", F.round(total, 4)))
    if "leaked" in tasks.columns:
        out = out.unionByName(row(tasks.filter(F.coalesce("leaked", F.lit(False))), "exact_benchmark_text_match", F.lit(None)))
    ids = tasks.select(F.col("task_id").alias("_t")).distinct()
    for name, child in children.items():
        out = out.unionByName(row(child.join(ids, F.col("task_id") == F.col("_t"), "left_anti"), f"unknown_task_id_in_{name}", F.lit(None)))
    return out


def unknown_values(values: list[str], allowed: list[str], what: str) -> list[str]:
    """`values` without blanks, in order; an error that names what isn't allowed."""
    given = [v.strip() for v in values if v.strip()]
    if bad := sorted(set(given) - set(allowed)):
        raise ValueError(f"unknown {what}: {', '.join(bad)}")
    return given


def duplicates(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(type, key, rows): keys found more than once."""
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.lit(kind).alias("type"), "key", "rows")
