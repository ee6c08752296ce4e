"""Reward heads, their fusion and attribution as column expressions; heads are columns of doubles, null where a row has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Heads of an item before any evidence.
DEFAULTS = {"program": 0.55, "cognitive": 0.5, "execution": 0.5, "preservation": 0.65, "region": 0.55, "quality": 0.65, "readability": 0.65, "tool": 0.5, "format": 0.5}
#: Tools that bring knowledge.
KNOWLEDGE_TOOLS = ["search", "query_edit_knowledge", "solve_symbolic"]

Heads = dict[str, Column]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _or(heads: Heads, name: str, default: float | Column) -> Column:
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(heads[name], other) if name in heads else other


def fuse(heads: Heads, editor_fail: Column | None = None) -> Column:
    """The reward of an agent: image evidence gated by the weaker of execution and cognition, plus program, tool and format."""
    quality = clamp(_or(heads, "quality", 0.0))
    gate = F.least(clamp(_or(heads, "execution", 0.0)), clamp(_or(heads, "cognitive", 1.0)))
    image = gate * (0.45 + 0.20 * clamp(_or(heads, "preservation", 0.0)) + 0.15 * clamp(_or(heads, "region", 0.0)) + 0.10 * quality + 0.10 * clamp(_or(heads, "readability", quality)))
    program = clamp(_or(heads, "program", 0.0))
    agent = 0.45 * program + 0.45 * image + 0.05 * clamp(_or(heads, "tool", 0.0)) + 0.05 * clamp(_or(heads, "format", 0.0))
    if editor_fail is not None:
        agent = F.when(F.coalesce(editor_fail, F.lit(False)), F.greatest(agent, 0.6 * program)).otherwise(agent)
    return clamp(agent)


def failure(heads: Heads) -> Column:
    """The first failure that fits; a head that is missing passes, but program must be there to blame the editor."""
    h = lambda name: _or(heads, name, 1.0)
    return (
        F.when(h("format") < 0.5, "format_fail")
        .when((h("program") < 0.55) | (h("cognitive") < 0.45), "planner_fail")
        .when(h("region") < 0.45, "region_fail")
        .when((h("execution") < 0.45) & (_or(heads, "program", 0.0) >= 0.65), "editor_fail")
        .when(h("preservation") < 0.45, "over_edit")
        .when(h("execution") < 0.45, "under_edit")
        .otherwise("none")
    )


def credit_hints(heads: Heads, failed: Column) -> Column:
    """The groups of tokens to blame, in order."""
    h = lambda name: _or(heads, name, 1.0) < 0.6
    none = F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            F.when(h("tool"), "tool_call").otherwise(none),
            F.when(h("cognitive") | (failed == "planner_fail"), "reasoning").otherwise(none),
            F.when(h("region"), "region").otherwise(none),
            F.when(h("preservation") | (failed == "over_edit"), "preservation").otherwise(none),
            F.when(h("execution"), "editor_prompt").otherwise(none),
        )
    )


def program_heads(ok: Column, errors: Column, warnings: Column, present: list[Column], knowledge: Column, tools: Column) -> Heads:
    """Heads of an edit program: errors and warnings are counts, present says which of the six parts are there, tools are names of calls."""
    base = F.when(ok, 1.0).otherwise(F.greatest(F.lit(0.0), 0.6 - 0.1 * errors))
    form = F.when(warnings > 0, F.greatest(F.lit(0.0), base - F.least(F.lit(0.25), 0.05 * warnings))).otherwise(base)
    share = sum((F.when(p, 1).otherwise(0) for p in present), F.lit(0)) / len(present)
    program = F.when(knowledge, F.least(F.lit(1.0), share + 0.08)).otherwise(share)
    has = lambda names: F.when(F.arrays_overlap(tools, F.array(*map(F.lit, names))), 0.2).otherwise(0.0)
    calm = F.when((F.size(tools) <= 8) & ~F.exists(tools, lambda t: F.coalesce(t, F.lit("")) == ""), 0.1).otherwise(0.0)
    tool = F.when(F.size(tools) > 0, 0.5 + has(["analyze_image"]) + has(KNOWLEDGE_TOOLS) + calm).otherwise(0.5)
    return {"program": clamp(program), "format": clamp(form), "tool": clamp(tool)}


def change(source_hash: Column, candidate_hash: Column) -> dict[str, Column]:
    """How much an image changed by its 64-bit hashes: bits, share, whether enough, and whether not everywhere; null without both."""
    bits = T.hamming(source_hash, candidate_hash)
    share = bits / F.lit(64.0)
    return {"hamming": bits, "normalized": share, "enough_change": clamp(share / 0.08), "not_global_drift": 1.0 - clamp(F.greatest(F.lit(0.0), share - 0.45) / 0.35)}


def prior(image: Column) -> Column:
    """What the name of a rendered image says of it."""
    name = F.lower(T.path_name(image))
    has = lambda *parts: T.contains_any(name, list(parts))
    return F.when(has("_teacher", "teacher_render"), "teacher").when(has("_negative", "negative_render"), "negative")


def item_heads(given: Heads, delta: dict[str, Column], image: Column, failure_type: Column, priors: bool = True) -> Heads:
    """All heads of an item: defaults, then the program's, then the evidence of the image change, then what the render's name says."""
    h: Heads = {k: F.coalesce(given[k], F.lit(v)) if k in given else F.lit(v) for k, v in DEFAULTS.items()}
    there, calm = delta["hamming"].isNotNull(), delta["not_global_drift"]
    h["execution"] = F.when(there, F.greatest(h["execution"], 0.35 + 0.45 * delta["enough_change"])).otherwise(h["execution"])
    h["preservation"] = F.when(there, F.least(h["preservation"], calm)).otherwise(h["preservation"])
    h["region"] = F.when(there, F.least(F.lit(0.85), 0.45 + 0.45 * calm)).otherwise(h["region"])
    if priors:
        p = prior(image)
        teacher, negative = F.coalesce(p == "teacher", F.lit(False)), F.coalesce(p == "negative", F.lit(False))
        for name, floor in {"cognitive": 0.95, "execution": 0.95, "preservation": 0.9, "region": 0.9, "quality": 0.9, "readability": 0.9}.items():
            h[name] = F.when(teacher, F.greatest(h[name], F.lit(floor))).otherwise(h[name])
        kind = F.when(F.coalesce(failure_type, F.lit("")) == "", "reasoning_or_region_error").otherwise(failure_type)
        for name, cap, also in (("cognitive", 0.25, None), ("execution", 0.25, None), ("region", 0.25, F.contains(kind, F.lit("region"))), ("quality", 0.65, None)):
            on = negative if also is None else negative & also
            h[name] = F.when(on, F.least(h[name], F.lit(cap))).otherwise(h[name])
    return {k: clamp(v) for k, v in h.items()}


def checklist_head(question: Column) -> Column:
    """The head that answers a checklist question."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return (
        F.when(T.contains_any(q, ["reason", "knowledge", "discipline"]), "cognitive")
        .when(T.contains_any(q, ["unrelated", "preserve", "background"]), "preservation")
        .when(T.contains_any(q, ["clear", "artifact"]), "quality")
        .otherwise("execution")
    )


def checklist_results(questions: Column, heads: Heads) -> Column:
    """For each question its head, that head's score and whether it passes (0.65)."""
    scores = F.create_map(*(x for k in ("cognitive", "preservation", "quality", "execution") for x in (F.lit(k), _or(heads, k, 0.0))))
    return F.transform(questions, lambda q: F.struct(q.alias("question"), checklist_head(q).alias("head"), scores[checklist_head(q)].alias("score"), (scores[checklist_head(q)] >= 0.65).alias("pass")))


def difference_report(allowed: Column, heads: Heads) -> Column:
    """{intended, missing, unintended, implied}: the allowed changes count as made from an execution of 0.65 on; below that of preservation, drift is possible."""
    made, calm = _or(heads, "execution", 0.0) >= 0.65, _or(heads, "preservation", 0.0) >= 0.65
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(made, allowed).otherwise(none).alias("intended"), F.when(made, none).otherwise(allowed).alias("missing"),
        F.when(calm, none).otherwise(F.array(F.lit("possible non-target drift"))).alias("unintended"), none.alias("implied"),
    )


def scored(heads: Heads, allowed: Column, questions: Column) -> dict[str, Column]:
    """All columns that come of scoring a verifier's item or an agent's result: score, failure, hints, difference report, checklist."""
    failed = failure(heads)
    return {"score": F.round(fuse(heads), 4), "primary_failure": failed, "hints": credit_hints(heads, failed), "difference_report": difference_report(allowed, heads), "checklist_results": checklist_results(questions, heads)}


def filter_score(level: Column) -> Column:
    """The base score of a task by its difficulty."""
    return F.greatest(F.lit(0.76), 0.96 - 0.025 * level)


#: Review failures that reject by themselves.
CRITICAL = [
    "benchmark_leak", "split_or_license_risk", "not_same_pair", "different_image_context", "before_after_reversed", "wrong_edit",
    "missing_edit", "wrong_region", "instruction_mismatch", "unsafe_content", "unsafe_or_watermarked",
]


def review(failures: Column, same: Column, faithful: Column, preservation: Column, artifact: Column, clarity: Column, overall: Column) -> Column:
    """accept, review or reject; a null score triggers nothing."""
    named = F.transform(F.coalesce(failures, F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    bad = yes(F.arrays_overlap(named, F.array(*map(F.lit, CRITICAL)))) | yes(same <= 2) | yes(faithful <= 2) | yes(clarity <= 1) | yes(artifact >= 4)
    weak = yes(artifact >= 3)
    for s in (same, faithful, preservation, clarity, overall):
        weak = weak | yes(s < 4)
    return F.when(bad, "reject").when(weak, "review").otherwise("accept")


def with_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-6, name: str = "advantage") -> DataFrame:
    """`df` with the reward relative to its group: distance from the mean in standard deviations.

    The groups' figures are an aggregation with map-side combine that is joined back, so a group of a third of all rows is
    never in one task. Rows without a group have no advantage.
    """
    some = df.filter(F.col(group).isNotNull())
    per = some.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    out = some.join(per, group).withColumn(name, (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")
    return out.unionByName(df.filter(F.col(group).isNull()).withColumn(name, F.lit(None).cast("double")))


#: Least scores of an accepted sample.
ACCEPT = {"evidence": 0.75, "execution": 0.80, "checklist": 0.80, "render": 0.75}


def accepted(scores: Heads) -> Column:
    """Whether all given scores reach their thresholds."""
    out = F.lit(True)
    for k, least in ACCEPT.items():
        out = out & (F.coalesce(scores[k], F.lit(0.0)) >= least)
    return out
