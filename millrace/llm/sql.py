"""SQL for DuckDB that gives the rows of the queries it can express, by brute force over whole tables."""

from __future__ import annotations

from millrace.llm.p1_cross_split import EVAL, TRAIN
from millrace.llm.p2_incremental import EMPTY_DIGEST
from millrace.llm.p3_grouped_splits import NOBODY
from millrace.llm.p7_quality import BULLET, CJK, ENDS

WIDE, NARROW = ("".join(chr(start + i) for i in range(94)) for start in (0xFF01, 0x21))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(x: str) -> str:
    """The words of a text as read, in order; of the named character escapes those that the tables have."""
    x = f"regexp_replace(coalesce({x}, ''), '<[/!?]?[a-zA-Z][^<>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&shy;", ""), ("&amp;", "&")):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    x = f"strip_accents(lower(translate({x}, {quoted(WIDE)}, {quoted(NARROW)})))"
    return rf"regexp_extract_all(regexp_replace({x}, '[\p{{Mn}}\p{{Me}}\p{{Cf}}]', '', 'g'), '[a-z0-9]+')"


def near(source: str) -> str:
    """CTEs `near` (x, y): pairs of distinct word sets of `source` (a relation with s, a sorted list) that are nearly the same, both ways, each with itself."""
    return f"""sets as (select row_number() over () as i, s, len(s) as n from (select distinct s from {source} where len(s) >= 5)), flat as (select i, n, unnest(s) as w from sets),
pairs as (select a.i as x, b.i as y, a.n as nx, b.n as ny, count(*) as c from flat a join flat b on a.w = b.w and a.i < b.i and a.n * 10 >= b.n * 8 and b.n * 10 >= a.n * 8 group by all),
near0 as (select x, y from pairs where c * 10 >= (nx + ny - c) * 8), near as (select x, y from near0 union all select y, x from near0 union all select i, i from sets)"""


def _instructions() -> str:
    w = lambda x: f"list_sort(list_distinct({words(x)}))"
    return f"r as (select distinct task_id, {w('t')} as s from (select task_id, refined.instruction as t from tasks_v1_refined_pilot3 union all select task_id, instruction from real_seed_prompts_v2_seed))"


def p4_found() -> str:
    return f"""with {_instructions()}, {near("r")}, m as (select task_id, i from r join sets using (s))
select distinct a.task_id as task_id_a, b.task_id as task_id_b from near join m a on a.i = x join m b on b.i = y where a.task_id < b.task_id"""


def p4_groups() -> str:
    return f"""with recursive {_instructions()}, {near("r")}, m as (select task_id, i from r join sets using (s)),
reach as (select i, i as j from sets union select reach.i, y from reach join near on x = j), heads as (select reach.i, min(m.task_id) as group_id from reach join m on m.i = j group by 1),
links as (select x as i, count(*) - 1 as links from near join m on m.i = y group by 1)
select r.task_id, min(coalesce(group_id, r.task_id)) as group_id, max(coalesce(links, 0)) as links from r left join m using (task_id) left join heads using (i) left join links using (i) group by 1"""


def _cross(standing: tuple[str, ...]) -> str:
    w = lambda x: f"list_sort(list_distinct({words(x)}))"
    name = r"regexp_replace(lower(trim(regexp_replace(split, '[\s\x{a0}\x{200b}\x{feff}]+', ' ', 'g'))), '[ -]+', '_', 'g')"
    split = lambda names: ", ".join(map(quoted, names))
    known = " union all ".join(f"select {w(quoted(s))} as k" for s in standing)
    return f"""k as ({known}), f as (select distinct task_id, {name} as split, source, field, {w("t")} as s from (select task_id, split, source, 1 as field, instruction as t from real_seed_prompts_v2_seed union all select task_id, split, source, 2, expected_target from real_seed_prompts_v2_seed)),
r as (select task_id, split, source, field, split in ({split(TRAIN)}) as train, s from f where split in ({split(TRAIN + EVAL)}) and not (field = 2 and exists (select 1 from k where len(list_intersect(s, k)) * 10 >= (len(s) + len(k) - len(list_intersect(s, k))) * 8))),
{near("r")}, m as (select task_id, split, source, field, train, i from r join sets using (s)),
c as (select distinct a.task_id as train_id, b.task_id as eval_id, b.split as eval_split, b.source from near join m a on a.i = x and a.train join m b on b.i = y and not b.train and a.field = b.field where a.task_id <> b.task_id)"""


def p1_found(standing: tuple[str, ...]) -> str:
    return f"with {_cross(standing)} select distinct least(train_id, eval_id) as task_id_a, greatest(train_id, eval_id) as task_id_b from c"


def p1_report(standing: tuple[str, ...]) -> str:
    return f"with {_cross(standing)} select eval_split, source, count(*) as pairs, count(distinct eval_id) as eval_records, count(distinct train_id) as train_records from c group by 1, 2"


P2_POOL = rf"""with d as (select image_id, batch_number as b, case when image.bytes > 0 then nullif(regexp_extract(lower(image.sha256), '(?:^|[^0-9a-f])([0-9a-f]{{64}})(?:[^0-9a-f]|$)', 1), '') end as h from wikimedia_source_pool_v2_seed),
o as (select image_id, row_number() over (partition by h order by b nulls last, image_id) as rn from (select distinct image_id, b, h from d where h is not null and h <> '{EMPTY_DIGEST}'))
select image_id as record_id from o where rn > 1"""

_FILE = r"regexp_replace(lower(url_decode(trim(source_image))), '[\\/]+', '/', 'g')"
_FILE = rf"regexp_replace(regexp_replace(regexp_replace({_FILE}, '^[a-z][a-z0-9+.-]*:/+', '/'), '^[a-z]:', ''), '(^|/)(?:\./)+', '\1', 'g')"
for _ in range(3):
    _FILE = rf"regexp_replace({_FILE}, '(^|/)[^/.][^/]*/\.\./', '\1')"
_FILE = rf"trim(regexp_replace(case when regexp_matches({_FILE}, '(?:^|/)data/') then regexp_extract({_FILE}, '(?:^|^.*?/)(data/.*)$', 1) else {_FILE} end, '^/+|/+$', '', 'g'))"


def _dataset(x: str) -> str:
    x = rf"lower(url_decode(trim(regexp_replace({x}, '[\s\x{{a0}}\x{{200b}}\x{{feff}}]+', ' ', 'g'))))"
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '^[a-z][a-z0-9+.-]*://(?:[^/]*\.[^/]*/)?', ''), '^/*(?:datasets/)?', ''), '[@?#].*$', '')"
    return rf"nullif(trim(regexp_replace({x}, '(?:\.git)?/*$', '')), '')"


def _groups() -> str:
    nobody = ", ".join(quoted(x) for x in sorted(NOBODY))
    return f"""s as (select distinct task_id as id, 'f:' || nullif({_FILE}, '') as f, case when array_to_string(w, ' ') not in ({nobody}) then 'w:' || array_to_string(w, ' ') end as w from (select task_id, source_image, {words("source_image_provenance.artist")} as w from real_seed_prompts_v2_seed)),
e as (select distinct coalesce(f, w) as a, coalesce(w, f) as b from s where f is not null or w is not null), c as (select distinct {_dataset("dataset_id")} as a, {_dataset("mirror_of")} as b from source_catalog),
e2 as (select a, b from e union select b, a from e union select 'd:' || a, 'd:' || a from c union select 'd:' || a, 'd:' || b from c where b in (select a from c) union select 'd:' || b, 'd:' || a from c where b in (select a from c) union select a, a from e union select b, b from e),
reach as (select a, b from e2 union select reach.a, e2.b from reach join e2 on e2.a = reach.b), root as (select a, min(b) as root from reach group by 1),
v as (select id, 'seed' as kind, coalesce(f, w) as v from s union select sample_id, 'pair', 'd:' || {_dataset("dataset_id")} from real_edit_pairs_rejected_v2_hf150),
k as (select distinct id, kind, root from v left join root on a = v.v), g as (select kind, root, min(id) as group_id, count(*) as size from k where root is not null group by 1, 2)"""


def p3_found() -> str:
    return f"with recursive {_groups()} select id as record_id, group_id from k join g using (kind, root) where size > 1"


_T = r"regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?|\x{2028}|\x{85}', chr(10), 'g'), '[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]', '', 'g')"
_T = rf"regexp_replace(regexp_replace({_T}, '\x{{a0}}|&nbsp;|\x{{3000}}', ' ', 'g'), '([.!?。！？…)\"”»])[ ]*\t', '\1 ', 'g')"
P7_COUNTS = rf"""with l as (select doc_id, list_filter(list_transform(string_split({_T}, chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') as lines from documents),
w as (select doc_id, lines, flatten(list_transform(lines, lambda x: regexp_extract_all(lower(regexp_replace(regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'), '({CJK})', ' \1 ', 'g')), '\S+'))) as words from l)
select doc_id, len(words) as n_words, len(lines) as n_lines, case when len(lines) > 0 then round(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(len(words), 1)::double, 6) end as mean_word,
case when len(lines) > 0 then round(len(list_filter(lines, lambda x: regexp_matches(x, {quoted(ENDS)}))) / len(lines)::double, 6) end as ends, case when len(lines) > 0 then round(len(list_filter(lines, lambda x: regexp_matches(x, {quoted(BULLET)}))) / len(lines)::double, 6) end as bullet_lines from w"""


def oracle_sql(standing: tuple[str, ...]) -> dict[str, str]:
    return {"p1_found": p1_found(standing), "p1_report": p1_report(standing), "p2_pool": P2_POOL, "p3_found": p3_found(), "p4_found": p4_found(), "p4_groups": p4_groups(), "p7_counts": P7_COUNTS}
