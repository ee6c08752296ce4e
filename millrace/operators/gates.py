"""Gates that accumulate reasons: a row passes if none of its gates has one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Terms that make a text unsafe, as substrings.
UNSAFE = [
    "nude", "naked", "nsfw", "porn", "sexual", "lingerie", "blood", "gore", "weapon", "gun", "bomb",
    "terrorist", "attack", "explosion", "explode", "fire", "burn", "disaster", "violent", "violence", "tsunami", "bare chest",
]
#: Phrases that need a further input image.
VISUAL = [
    "[v", "visual input", "reference image", "given depth image", "given segmentation", "given mask",
    "refer to the given", "follow the given", "watch the given", "according to the given",
]
#: Substrings of allowed licences, of collections and of the commons, and of splits for evaluation.
LICENSES = ["cc-by-4.0", "cc by 4.0", "mit", "apache-2.0", "apache 2.0"]
COMMONS = ["cc0", "public domain", "cc by", "cc-by", "cc by-sa", "cc-by-sa"]
EVALUATION = ["test", "eval", "evaluation", "dev", "validation", "val", "benchmark"]


def reasons(*gates: Column) -> Column:
    """One array of reasons, in the order of the gates; each gate is a string, an array of strings, or null."""
    return F.array_compact(F.flatten(F.array(*gates)))


def when(bad: Column, reason: str | Column) -> Column:
    """A gate: an array with the reason if `bad` holds; null counts as not."""
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(F.coalesce(bad, F.lit(False)), F.array(r)).otherwise(F.array().cast("array<string>"))


def joined(*fields: Column) -> Column:
    """The fields in small letters, one after another; null ones are left out."""
    return F.lower(F.concat_ws(" ", *fields))


def unsafe_terms(*fields: Column) -> Column:
    return T.terms_in(joined(*fields), UNSAFE)


def unsafe(*fields: Column) -> Column:
    return T.contains_any(joined(*fields), UNSAFE)


def needs_image(extra: Column | None, *fields: Column) -> Column:
    """Whether a row depends on a further image: it has one, or its text speaks of one."""
    phrase = T.contains_any(joined(*fields), VISUAL)
    return phrase if extra is None else extra.isNotNull() | phrase


def image_reasons(meta: Column, least_side: int, most_aspect: float, least_bytes: int, exists: Column | None = None) -> Column:
    """Reasons against an image by its record {width, height, bytes}; a missing figure counts as zero, a side of zero as aspect 999."""
    w, h, size = (F.coalesce(meta[c], F.lit(0)) for c in ("width", "height", "bytes"))
    short, long = F.least(w, h), F.greatest(w, h)
    aspect = F.when(short > 0, long / short).otherwise(F.lit(999.0))
    gates = [when(short < least_side, f"short_side_lt_{least_side}"), when(aspect > most_aspect, f"aspect_gt_{most_aspect:g}" if most_aspect == int(most_aspect) else f"aspect_gt_{most_aspect}"), when(size < least_bytes, "file_too_small")]
    return reasons(*([when(~exists, "missing_image_file")] if exists is not None else []), *gates)


def strict_image(meta: Column, exists: Column | None = None) -> Column:
    return image_reasons(meta, 384, 2.5, 8192, exists)


def loose_image(meta: Column) -> Column:
    return image_reasons(meta, 256, 3.0, 4096)


def license_reason(license: Column, research: bool = False) -> Column:
    """The reason against a licence, or null; a non-commercial one is judged by `research` alone."""
    low = F.lower(F.coalesce(license, F.lit("")))
    closed = F.lit(None).cast("string") if research else F.lit("non_commercial_license")
    return F.when(T.contains_any(low, ["cc-by-nc", "non-commercial"]), closed).when(~T.contains_any(low, LICENSES), F.lit("license_not_in_allowlist"))


def commons_ok(license: Column) -> Column:
    return T.contains_any(F.lower(license), COMMONS)


def split_reason(split: Column) -> Column:
    """The reason against a split whose name holds one of an evaluation split, or null."""
    low = F.lower(F.coalesce(split, F.lit("")))
    return F.when(T.contains_any(low, EVALUATION), F.concat(F.lit("eval_like_split:"), low))


def one(reason: Column) -> Column:
    """A gate of a nullable reason."""
    return F.when(reason.isNotNull(), F.array(reason)).otherwise(F.array().cast("array<string>"))


def allowed_edit(edit_type: Column, excluded: list[str]) -> Column:
    """Whether a normalized edit type isn't excluded; to be asked before anything is fetched. Null is allowed."""
    return ~F.coalesce(T.normalize(edit_type).isin(*(x.lower().strip() for x in excluded)), F.lit(False)) if excluded else F.lit(True)


def pair_reasons(duplicate: Column, key: list[Column], texts: list[Column] | None = None, extra: Column | None = None) -> Column:
    """All reasons against an edit pair, in order: key, duplicate, safety, visual input, leakage, quality, images, licence, split.

    texts: all texts of the pair (captions and inputs too, where it has them), by default instruction and edit type; extra: a further input image.
    """
    texts = [F.col("instruction"), F.col("edit_type")] if texts is None else texts
    missing = F.lit(False)
    for k in key:
        missing = missing | (F.coalesce(k, F.lit("")) == "")
    image = lambda c: F.transform(strict_image(F.col(c)), lambda r: F.concat(F.lit(f"{c}:"), r))
    return reasons(
        when(missing, "missing_key_fields"),
        when(~missing & duplicate, "duplicate_pair_or_instruction"),
        when(unsafe(*texts), "unsafe_text"),
        when(needs_image(extra, *texts), "visual_input_dependent"),
        when(F.col("leakage_tags.benchmark_text_exact_match"), "exact_benchmark_text_match"),
        when(~F.col("quality_tags.ok"), "upstream_quality_reject"),
        image("source_image"),
        image("target_image"),
        one(license_reason(F.col("license"))),
        one(split_reason(F.col("split"))),
    )
