"""Conversions between record shapes: checklists, conversations, programs, prompts, and the rows each is made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of checklist groups; any other group has OTHER.
BUDGETS = {"visual": 0.35, "cognitive": 0.30, "preservation": 0.25, "readability": 0.10}
OTHER = 0.1

ITEM = "array<struct<id:string,group:string,question:string,weight:double>>"


def budget(group: Column) -> Column:
    out = F.lit(OTHER)
    for name, share in BUDGETS.items():
        out = F.when(group == name, share).otherwise(out)
    return out


def active_groups(groups: Column) -> Column:
    """The entries of a map of questions by group, in order, without empty groups."""
    return F.filter(F.map_entries(groups), lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0)


def weighted_checklist(groups: Column) -> Column:
    """Questions with ids C1.. in group order; each group's share, scaled to a sum of one over the groups there are, is split equally."""
    active = active_groups(groups)
    total = F.aggregate(active, F.lit(0.0), lambda s, e: s + budget(e["key"]))
    flat = F.flatten(F.transform(active, lambda e: F.transform(e["value"], lambda q: F.struct(e["key"].alias("group"), q.alias("question"), F.round(budget(e["key"]) / total / F.size(e["value"]), 4).alias("weight")))))
    return F.transform(flat, lambda x, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("id"), x["group"].alias("group"), x["question"].alias("question"), x["weight"].alias("weight"))).cast(ITEM)


def flat_checklist(items: Column | None, grouped: Column | None = None) -> Column:
    """A checklist given as a list, or as lists by group, whose name is an item's category unless it has its own."""
    if grouped is None:
        return F.filter(items, lambda x: x.isNotNull())
    return F.flatten(F.transform(F.map_entries(grouped), lambda e: F.transform(F.filter(e["value"], lambda x: x.isNotNull()), lambda x: x.withField("category", F.coalesce(x["category"], e["key"])))))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sharegpt(instruction: Column, answer: Column) -> Column:
    """A conversation of a human, with the image mark, and the model."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.array(turn("human", F.concat(F.lit("<image>\n"), F.trim(instruction))), turn("gpt", answer))


def chat(system: str, instruction: Column, answer: Column | None = None) -> Column:
    """System, user and, if given, assistant messages."""
    user = message("user", F.concat(F.lit("<image>\n"), F.trim(instruction)))
    return F.array(message("system", F.lit(system)), user, *([message("assistant", answer)] if answer is not None else []))


def wrapped(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))


def answer(program_json: Column) -> Column:
    """The answer text of a program, keys sorted."""
    return wrapped("answer", F.to_json(F.try_parse_json(program_json)))


def first_user(messages: Column) -> Column:
    """The texts of the first user message, joined by a space; messages: array of {role, content: array of {type, text}}."""
    user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))
    texts = F.transform(F.filter(user["content"], lambda p: p["type"] == "text"), lambda p: F.trim(p["text"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def tool_calls(messages: Column) -> Column:
    """All tool calls of a conversation, in order."""
    return F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array())))


def rendered_trace(messages: Column) -> Column:
    """Thoughts, calls and responses of the assistant, a line each; messages: {role, content, tool_calls: array of {name, arguments, result}}, in JSON where structured."""
    def lines(m: Column) -> Column:
        thought = F.when(F.trim(F.coalesce(m["content"], F.lit(""))) != "", F.array(wrapped("think", F.trim(m["content"])))).otherwise(F.array().cast("array<string>"))
        calls = F.flatten(
            F.transform(
                F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:string,result:string>>")),
                lambda c: F.concat(
                    F.array(wrapped("tool_call", F.to_json(F.struct(c["arguments"].alias("arguments"), c["name"].alias("name"))))),
                    F.when(c["result"].isNotNull(), F.array(wrapped("tool_response", F.to_json(F.struct(c["name"].alias("name"), c["result"].alias("result")))))).otherwise(F.array().cast("array<string>")),
                ),
            )
        )
        return F.concat(thought, calls)

    return F.array_join(F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lines)), "\n")


def expected_diff(ops: Column, preserved: Column, facts: Column, description: Column) -> Column:
    """What may change (of each operation the first of change, target, region that isn't empty; else the description), what is protected, and what must be known."""
    full = lambda c: F.nullif(c, F.lit(""))
    changes = F.array_compact(F.transform(F.coalesce(ops, F.array()), lambda o: F.coalesce(full(o["change"]), full(o["target"]), full(o["region_hint"]))))
    told = F.when(F.coalesce(description, F.lit("")) != "", F.array(description)).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(F.size(changes) > 0, changes).otherwise(told).alias("allowed_changes"), F.coalesce(preserved, F.array().cast("array<string>")).alias("protected_content"), F.concat(F.coalesce(facts, F.array().cast("array<string>")), told).alias("cognitive_targets"))


def fan_out(df: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """Each row once for each (kind, mode), in place."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mode")) for k, m in kinds))
    return df.withColumn("_x", F.explode(rows)).select(*df.columns, "_x.kind", "_x.mode")


#: Rows made of each task to teach understanding: answering, telling differences, judging.
UNDERSTANDING = [("vqa", "teacher"), ("diff", "teacher"), ("diff", "negative"), ("judge", "teacher"), ("judge", "negative")]


def merged(tasks: DataFrame, refined: DataFrame, rejected: DataFrame, keep: bool = False) -> DataFrame:
    """Tasks with the texts of their last refined record, unless it was rejected; without one a task is dropped, or kept as it is.

    refined: task_id, seq, ok, refined; columns replaced: instruction. `refined_by` says which tasks were.
    """
    last = refined.filter("ok and refined is not null").groupBy("task_id").agg(F.max_by("refined", "seq").alias("_r")).join(rejected, "task_id", "left_anti")
    out = tasks.join(last, "task_id", "left" if keep else "inner")
    return out.withColumn("instruction", F.when(F.col("_r").isNotNull(), F.col("_r.instruction")).otherwise(F.col("instruction"))).withColumn("was_refined", F.col("_r").isNotNull()).drop("_r")


#: Of each source schema where its texts and images are: instruction candidates in order, source and target image.
SCHEMAS = {
    "magicbrush": (["instruction"], "source_img", "target_img"),
    "imagenhub": (["instruction"], "source_img", "target_img"),
    "anyedit": (["edit_instruction", "input"], "image_file", "edited_file"),
    "omniedit": (["edited_prompt_list", "task"], "src_img", "edited_img"),
    "anyedit_thinking": (["edit_instruction"], "input_image", "output_image"),
}


def unified_pair(raw: Column, schema: Column) -> Column:
    """{instruction, source_url, target_url} of a source's raw JSON row: the first text that isn't empty, of a list the last; null for an unknown schema."""
    at = lambda f: F.get_json_object(raw, f"$.{f}")
    out = F.lit(None).cast("struct<instruction:string,source_url:string,target_url:string>")
    for name, (texts, source, target) in SCHEMAS.items():
        parts = []
        for t in texts:
            many = F.from_json(at(t), "array<string>")
            parts.append(F.nullif(F.when(F.coalesce(at(t), F.lit("")).startswith("["), F.try_element_at(many, F.lit(-1))).otherwise(at(t)), F.lit("")))
        row = F.struct(F.coalesce(*parts).alias("instruction"), at(f"{source}.src").alias("source_url"), at(f"{target}.src").alias("target_url"))
        out = F.when(schema == name, row).otherwise(out)
    return out
