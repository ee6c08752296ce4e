"""Text functions, Column to Column; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Small letters; everything but a-z, 0-9 and CJK ideographs is one space; trimmed. Null stays null.

    Taking the words out and joining them was measured at a tenth of the time of replacing what lies between them.
    """
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9一-鿿]+"), F.lit(0)), " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def words(normalized: Column) -> Column:
    """The words of a normalized text; an empty text has none. Materialise it before use in a lambda."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def windows(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_set(tokens: Column, n: int = 5) -> Column:
    """The set of n-grams; a text of fewer words is one gram, an empty one has none."""
    return F.when(F.size(tokens) >= n, F.array_distinct(windows(tokens, n))).when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def slug(text: Column, most: int = 80) -> Column:
    """An identifier: runs of other characters become one underscore; underscores at the ends go before the cut; `item` if nothing is left."""
    s = F.left(F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")), F.lit(most))
    return F.when(s == "", F.lit("item")).otherwise(s)


def strip_tags(text: Column) -> Column:
    """Tags become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\s\p{Z}]+", " "))


def shorten(text: Column, most: int) -> Column:
    """The text, or its beginning with three dots, `most` characters in all."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a substring: null and empty texts contain none."""
    def any_in(x: Column) -> Column:
        out = F.contains(x, F.lit(terms[0]))
        for t in terms[1:]:
            out = out | F.contains(x, F.lit(t))
        return out

    return F.coalesce(F.exists(F.array(text), any_in), F.lit(False))  # as a lambda's variable the text is made once


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that are substrings, in their given order."""
    one = F.transform(F.array(F.coalesce(text, F.lit(""))), lambda x: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)))
    return one[0]


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 64-bit hashes written as 16 hex digits; null if either is null or not such a hash."""
    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")

    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))


def answer(text: Column) -> Column:
    """An answer for comparison: small letters, digits, letters and white space only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""))


def answer_tokens(text: Column) -> Column:
    """Tokens of an answer; arrows, commas, brackets, `and` and `then` separate. Tokens with other characters don't count."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), r"->|→|[,;\[\]()]", " "), " and | then ", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " "), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))


def same_answer(expected: Column, got: Column) -> Column:
    """Equal, or one contains the other and isn't empty, or the same tokens."""
    e, g = answer(F.coalesce(expected, F.lit(""))), answer(F.coalesce(got, F.lit("")))
    te, tg = answer_tokens(F.coalesce(expected, F.lit(""))), answer_tokens(F.coalesce(got, F.lit("")))
    return (e == g) | ((e != "") & F.contains(g, e)) | ((g != "") & F.contains(e, g)) | ((F.size(te) > 0) & (te == tg))


def score(value: Column) -> Column:
    """A number, or null for what isn't one."""
    return value.try_cast("double")


def json_object(text: Column) -> Column:
    """The JSON object in a reply: fences taken off, or else from the first to the last brace; null if there is none that parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?i:json)?\\s*", ""), "\\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.to_json(F.try_parse_json(bare)), F.to_json(F.try_parse_json(inner)))


def style(task_id: Column, styles: int = 7) -> Column:
    """The sum of code points modulo the number of styles."""
    return F.pmod(F.aggregate(F.split(task_id, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.ascii(c)), F.lit(styles)).cast("int")


def path_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, "[^/]*$", 0)


def wrap(text: Column, width: int) -> Column:
    """Greedy wrapping: lines of at most `width` characters unless one word is longer."""
    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        longer = F.concat(last, F.lit(" "), word)
        return F.when(F.size(lines) == 0, F.array(word)).when(F.length(longer) <= width, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"), add)


def canonical_json(value: Column) -> Column:
    """JSON with the keys of objects sorted, for hashing."""
    return F.to_json(F.try_parse_json(value))


def stable_hash(value: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of canonical JSON."""
    return F.left(F.sha2(canonical_json(value), 256), F.lit(length))


def check_score(checks: Column) -> Column:
    """The weight of passed checks (expected, got, weight: null is 1) over that of all, to three places; a total of zero divides as one, no checks are null."""
    weight = lambda c: F.coalesce(c["weight"], F.lit(1.0))
    total = F.aggregate(checks, F.lit(0.0), lambda s, c: s + weight(c))
    won = F.aggregate(checks, F.lit(0.0), lambda s, c: s + F.when(same_answer(c["expected"], c["got"]), weight(c)).otherwise(0.0))
    return F.when(F.size(checks) > 0, F.round(won / F.when(total == 0, 1.0).otherwise(total), 3))


def task_id(version: Column, parts: list[Column], number: Column, default: str = "v2") -> Column:
    """r, the letters and digits of the version, the parts, and the number in five digits."""
    bare = F.regexp_replace(version, r"[^\p{L}\p{N}]", "")
    return F.concat(F.lit("r"), F.when(F.coalesce(bare, F.lit("")) == "", default).otherwise(bare), F.lit("_"), F.concat_ws("_", *parts), F.lit("_"), F.format_string("%05d", number.cast("bigint")))


#: What instructions are made of; {} is the core, {low} the core with a small first letter.
CORES = ["{}", "Using the source image as context, {low}", "Make only the requested reasoning edit: {}", "Edit the image so that the final visual state is correct: {}", "Apply the domain knowledge and update the image: {}", "Keep unrelated regions unchanged while you {low}"]
PREFIXES = [
    "", "For this benchmark-style editing task, ", "After inspecting the diagram, ", "With the original layout preserved, ", "Using the visible source image only as the starting point, ",
    "Perform the smallest sufficient edit: ", "Update the target region and leave the rest stable: ", "Reason about the requested outcome, then ",
]
SUFFIXES = [
    " Keep the camera view unchanged.", " Do not alter any unrelated object.", " Preserve the original background and visual style.", " Make the result visually plausible.", " Keep labels and non-target regions stable.",
    " Avoid adding decorative or explanatory text.", " The final image should satisfy the reasoning target, not just look different.", " Preserve object identity unless the instruction explicitly changes it.",
    " Keep the edit localized to the necessary region.", " Do not change the task premise or redraw the whole image.",
]
CONSTRAINTS = [
    "", " Focus on reasoning correctness.", " Prioritize non-edited-region consistency.", " The edited state should be directly visible.", " Avoid over-editing.", " The target state must be knowledge-plausible.",
    " Keep the source composition recognizable.", " Ensure the visual change matches the instruction exactly.",
]


def instruction(base: Column, core: Column, prefix: Column, suffix: Column, constraint: Column) -> Column:
    """An instruction from a base text and the numbers of its variants, each modulo how many there are; null numbers are zero."""
    at = lambda values, n: F.element_at(values, (F.pmod(F.coalesce(n, F.lit(0)), F.size(values)) + 1).cast("int"))
    low = F.concat(F.lower(F.substring(base, 1, 1)), F.substring(base, 2, 1 << 30))
    cores = F.array(*(F.concat(F.lit(c.split("{")[0]), low if "{low}" in c else base) for c in CORES))
    of = lambda values: F.array(*map(F.lit, values))
    return F.trim(F.concat(at(of(PREFIXES), prefix), at(cores, core), at(of(SUFFIXES), suffix), at(of(CONSTRAINTS), constraint)))


def csv_set(text: Column) -> Column:
    """The distinct entries of a comma-separated text, trimmed, in order; none for null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")))


def relative(path: Column, root: str) -> Column:
    """The path below a root folder, or as it is if it lies elsewhere."""
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
