"""Problem 7: per-document text quality statistics, and which documents aren't natural prose.

Each Arrow batch is taken apart into lines, words and sentences as flat arrays,
and all statistics are vectorized counts over these: words, mean word length,
shares of symbols, of lines ending in punctuation, of bulleted lines and of common
words (Spark's own published stop-word lists of LANGUAGES; each Chinese character counts as a word).

First stage: the published fixed thresholds of RULES, each on one statistic of the
document; all that fail are recorded in `failed`, one name each, and those of
DECISIVE are a reason. The others were made for web pages of one language and turn
good short, wrapped or Chinese prose away (README gives their figures), so they are
recorded only. They apply to documents of MIN_WORDS words or more, as published.

Second stage, for what TESTDATA.md asks (more than half of the text): each line is a
list entry, part of a table, junk or prose by fixed thresholds, and a document whose
lines other than prose hold over half of its characters fails, with the largest share
as the recorded reason. Two rules are for whole documents: broken encoding, and the
same words or sentence over and over.

Whole texts are read, each document by itself: nothing is shuffled. A null, empty
or blank text has counts of zero, null ratios, and neither failures nor a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame

from millrace.session import spread

#: Languages whose stop-word lists are common words.
LANGUAGES = ("english", "german", "french", "spanish")

LIST = r"^(?:[-*+•‣▪●◦·–—]|[0-9]{1,4}[.):]|\([0-9]{1,4}\)|\([a-zA-Z]\)|#[0-9]{1,4}|[A-Z]{1,2}[0-9]{1,4}[ .:)]|\[[ xX✓✗]?\]|[☐☑☒✓✔✗✘]|[a-zA-Z][.)])\s+\S"
HARD = r"^\|.*\|$|</?(?:td|tr|th|table|tbody|thead)\b|^[\[{].*[}\]],?$|^[+|=-]{4,}$"
#: What makes a line a row of cells, by the separator that it must have.
TABLE = {
    "=": r"^(?:.*?[\p{L}\p{N}_.-]=\S){3}",
    "\t": r"\t.*\t|^[^.!?\t]*\S\t\S[^.!?\t]*$",
    ";": r"^[^;]*;[^; ][^;]*;|^(?:[^;]{0,30};){2,}[^;]{0,30}$|;;",
    ",": r"^(?:[^,]{0,30},[^, ]?){2,}[^,]{0,30}$|,,|^(?:[^,]{0,30},){2,}[^,. ][^,]{0,30}",
    "   ": r"[^\s.!?]\s{3,}\S|^\S.{0,40}\s{3,}\S",
}
PAIR = r"^[\p{L}\p{N}_ '’.-]{1,30}\s?[:=]\s?\S.{0,34}$"
LOG = r"^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}|\[(?:INFO|WARN|WARNING|ERR|ERROR|DEBUG|TRACE|FATAL)\]|\b0x[0-9a-f]{6,}\b"
MENU = r"^(?:[^«»›|]{1,30} [»›|] ){3,}[^«»›|]{1,30}$"
ENCODED = r"^[A-Za-z0-9+/=_-]{40,}$"
SYMBOL = r"[^\p{L}\p{N}\p{M}\s.,;:!?'\"()\-–—…。，、；：！？（）“”‘’«»„¿¡%&]"
BROKEN = r"[ÃÂ][^\p{L}\p{N}\s]|Ã[\x{80}-\x{bf}]|[âäåæçèéïð][\x{80}-\x{bf}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+|ï¿½|\x{fffd}"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
ENDS = r"[.!?。！？…][\"”’»)\]]*$"
#: Fixed thresholds.
SYMBOLS, BROKEN_SHARE, COMMON_SHARE, LONG_WORD, REPEATED, DISTINCT, FEW_WORDS, LEAST_WORDS = 0.12, 0.06, 0.12, 18, 0.5, 0.2, 30, 40
KINDS = ("list", "table", "junk")
BULLET = r"^(?:[-*+•‣▪●◦·–—])\s"
#: Fixed thresholds, as published: Gopher (Rae et al. 2021, tables A1 and 11), C4 (Raffel et al. 2020) and FineWeb (Penedo et al. 2024); each names a statistic and the values that pass.
RULES = {
    "gopher_mean_word_length": ("mean_alphabetic", 3.0, 10.0),
    "gopher_symbol_to_word": ("marks", 0.0, 0.1),
    "gopher_bullet_lines": ("bullet_lines", 0.0, 0.9),
    "gopher_ellipsis_lines": ("ellipsis_lines", 0.0, 0.3),
    "gopher_alphabetic_words": ("alphabetic", 0.8, 1.0),
    "gopher_stop_words": ("stop_words", 2.0, np.inf),
    "gopher_duplicate_lines": ("duplicate_lines", 0.0, 0.3),
    "gopher_duplicate_line_characters": ("duplicate_chars", 0.0, 0.2),
    "c4_curly_bracket": ("braces", 0.0, 0.0),
    "fineweb_line_punctuation": ("ends", 0.12, 1.0),
    "fineweb_short_lines": ("short_lines", 0.0, 0.67),
}
DECISIVE = ("gopher_mean_word_length", "gopher_symbol_to_word", "gopher_bullet_lines", "gopher_alphabetic_words", "gopher_stop_words", "gopher_duplicate_lines", "gopher_duplicate_line_characters")
#: Least words of a document to which published rules apply (Gopher).
MIN_WORDS = 50


def _count(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(a, pattern).to_numpy(zero_copy_only=False).astype(np.float64)


def _has(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)


def _has_with(a: pa.Array, mark: str, pattern: str) -> np.ndarray:
    """Which values match; only those that hold `mark` are tried."""
    out = pc.match_substring(a, mark).to_numpy(zero_copy_only=False).copy()
    at = np.flatnonzero(out)
    out[at] = _has(a.take(pa.array(at)), pattern)
    return out


def _lists(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array, and the row of each."""
    return a.flatten(), pc.list_parent_indices(a).to_numpy(zero_copy_only=False)


def common_words(languages: tuple[str, ...] = LANGUAGES) -> list[str]:
    """The stop words that Spark publishes for the languages, cut at apostrophes as words are here; needs a running session."""
    return sorted({w for name in languages for x in StopWordsRemover.loadDefaultStopWords(name) for w in re.findall(r"[^\W_]+", x.lower())})


def describe(texts: pa.Array, common_list: list[str]) -> dict[str, np.ndarray]:
    """All statistics of a batch of texts, and the share of each kind of line."""
    n = len(texts)
    t = pc.fill_null(texts, "")
    t = pc.replace_substring_regex(t, r"\r\n?|\x{2028}|\x{85}", "\n")
    t = pc.replace_substring_regex(t, r"[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]", "")
    t = pc.replace_substring_regex(t, r"\x{a0}|&nbsp;|\x{3000}", " ")
    t = pc.replace_substring_regex(t, r"([.!?。！？…)\"”»])[ ]*\t", "\\1 ")
    lines, row = _lists(pc.split_pattern(t, "\n"))
    tabbed = pc.utf8_trim(lines, " \x0b\x0c")
    lines = pc.utf8_trim_whitespace(lines)
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.float64)
    full = size > 0
    keep = pa.array(full)
    lines, tabbed, row, size = lines.filter(keep), tabbed.filter(keep), row[full], size[full]
    per_doc = lambda x: np.bincount(row, x, n)

    bare = pc.replace_substring_regex(lines, r"[^\p{L}\p{N}\p{M}]+", " ")
    words, at = _lists(pc.utf8_split_whitespace(pc.utf8_lower(pc.replace_substring_regex(bare, f"({CJK})", " \\1 "))))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)
    real = length > 0
    words, at, length = words.filter(pa.array(real)), at[real], length[real]
    common = pc.is_in(words, value_set=pa.array(common_list)).to_numpy(zero_copy_only=False)
    m = len(lines)
    nw, nc, wl = np.bincount(at, minlength=m), np.bincount(at, common, m), np.bincount(at, length, m)
    cjk, symbols, broken = _count(lines, CJK), _count(lines, SYMBOL), _count(lines, BROKEN)
    ends, bullet = _has(lines, ENDS), _has(lines, LIST)
    share = nc / np.maximum(nw - cjk, 1)
    chinese = cjk * 2 > wl
    spoken = (share >= COMMON_SHARE) | chinese & _has(lines, "[。！？]") | _long_chinese(lines, chinese & (size > 15), size)
    short = np.flatnonzero((nw <= 6) & (size <= 70))
    # lines that read as prose aren't cells, whatever their commas
    cells = np.zeros(m, bool)
    for mark, pattern in TABLE.items():
        cells |= _has_with(tabbed, mark, pattern)
    hard = _has(tabbed, HARD)
    table = hard | cells & ~((share >= 2 * COMMON_SHARE) | chinese & _has(lines, "[。！？]"))
    pair = np.zeros(m, bool)
    pair[short] = _has(lines.take(pa.array(short)), PAIR)
    pair &= ~ends
    junk = _has(lines, LOG) | _has(lines, ENCODED) | _has_with(lines, "»", MENU) | _has_with(lines, "›", MENU) | (symbols > SYMBOLS * size) | (wl > LONG_WORD * np.maximum(nw, 1)) & ~chinese & (size > 20)
    kind = np.select([table, junk, bullet | pair, ~spoken & (nw <= 6 + 2 * chinese), ~spoken], [2, 3, 1, 1, 3], 0)
    # a title or the short end of a wrapped paragraph is neither: it counts as the text around it
    kept = ~((kind == 1) & ~bullet & ~pair & (nw <= 6) & _alone(row, kind, bullet | pair | table))
    total = np.maximum(per_doc(size), 1)
    counted = np.maximum(per_doc(size * kept), 1)

    sentences, owner = _lists(pc.split_pattern_regex(pc.utf8_lower(t), r"[.!?。！？\n]+\s*"))
    code = sentences.dictionary_encode().indices.to_numpy().astype(np.int64)
    slen = pc.utf8_length(sentences).to_numpy(zero_copy_only=False).astype(np.float64)
    some = slen > 3
    code, owner, slen = code[some], owner[some], slen[some]
    _, first = np.unique(owner * (code.max(initial=0) + 1) + code, return_index=True)
    once = np.bincount(owner[first], slen[first], n)
    repeated = 1 - once / np.maximum(np.bincount(owner, slen, n), 1)

    wcode = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = row[at]
    distinct = np.bincount(np.unique(doc * (wcode.max(initial=0) + 1) + wcode) // (wcode.max(initial=0) + 1), minlength=n) if len(doc) else np.zeros(n)
    count = per_doc(nw.astype(np.float64))
    nl = per_doc(np.ones(m))
    letters = _has(words, r"\p{L}")
    latin = letters & ~_has(words, CJK)
    lcode = pc.utf8_lower(lines).dictionary_encode().indices.to_numpy().astype(np.int64)
    once_line = np.zeros(m, bool)
    once_line[np.unique(row * (lcode.max(initial=0) + 1) + lcode, return_index=True)[1]] = True
    stops = np.unique(doc[common] * (wcode.max(initial=0) + 1) + wcode[common]) // (wcode.max(initial=0) + 1)
    by_doc = lambda x: np.bincount(doc, x, n)
    return {
        "n_words": count, "n_lines": nl, "mean_word": per_doc(wl) / np.maximum(count, 1), "symbols": per_doc(symbols) / total, "ends": per_doc(ends.astype(float)) / np.maximum(nl, 1),
        "bullets": per_doc(bullet.astype(float)) / np.maximum(nl, 1), "common": per_doc(nc) / np.maximum(count, 1), "distinct": distinct / np.maximum(count, 1), "broken": per_doc(broken * 2) / total, "repeated": repeated,
        # words of Chinese characters have no length: the mean is that of the others, where these are most
        "mean_alphabetic": np.where(by_doc(latin) * 2 > count, by_doc(length * latin) / np.maximum(by_doc(latin), 1), 5.0), "marks": per_doc(_count(lines, r"#|\.\.\.|…")) / np.maximum(count, 1), "bullet_lines": per_doc(_has(lines, BULLET)) / np.maximum(nl, 1),
        "ellipsis_lines": per_doc(_has(lines, r"(?:\.\.\.|…)$")) / np.maximum(nl, 1), "alphabetic": by_doc(letters) / np.maximum(count, 1), "stop_words": np.bincount(stops, minlength=n).astype(float),
        "duplicate_lines": per_doc(~once_line) / np.maximum(nl, 1), "duplicate_chars": per_doc(size * ~once_line) / total, "braces": per_doc(_count(lines, "[{]")), "short_lines": per_doc(size < 30) / np.maximum(nl, 1),
        **{k: per_doc(size * kept * (kind == i + 1)) / counted for i, k in enumerate(KINDS)}, "some": (per_doc(size) > 0).astype(float), "chinese": per_doc(cjk) / total,
    }


def _long_chinese(lines: pa.Array, some: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Chinese lines whose parts between separators are long."""
    out, at = np.zeros(len(size), bool), np.flatnonzero(some)
    out[at] = size[at] >= 12 * (1 + _count(lines.take(pa.array(at)), "[，、,;；|/· »]"))
    return out


def _alone(row: np.ndarray, kind: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Lines with no other short or marked line beside them in their document."""
    like = (kind == 1) & ~marked
    before = np.zeros(len(row), bool)
    before[1:] = like[:-1] & (row[1:] == row[:-1])
    after = np.zeros(len(row), bool)
    after[:-1] = like[1:] & (row[1:] == row[:-1])
    return like & ~before & ~after


def failures(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Which texts fail each published rule; rules of words in spaces don't judge Chinese texts."""
    some = s["n_words"] >= MIN_WORDS
    spaced = s["chinese"] < 0.5
    return {name: some & ((s[at] < low) | (s[at] > high)) & (spaced if name == "gopher_stop_words" else True) for name, (at, low, high) in RULES.items()}


def reasons(s: dict[str, np.ndarray]) -> np.ndarray:
    """Why each text isn't natural prose, or None."""
    shares = np.stack([s[k] for k in KINDS])
    out = np.where(shares.sum(0) > 0.5, np.array(KINDS)[shares.argmax(0)], None).astype(object)
    out[(s["n_words"] >= LEAST_WORDS) & (s["distinct"] < DISTINCT) & (s["distinct"] * s["n_words"] <= FEW_WORDS) | (s["repeated"] > REPEATED)] = "repetition"
    out[s["broken"] > BROKEN_SHARE] = "encoding"
    for name, bad in reversed(failures(s).items()):
        if name in DECISIVE:
            out[bad] = name
    out[s["some"] == 0] = None
    return out


COLUMNS = {"n_words": "long", "n_lines": "long", "mean_word": "double", "symbols": "double", "ends": "double", "bullets": "double", "common": "double", **{at: "double" for at, _, _ in RULES.values() if at != "ends"}}


def quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the statistics of COLUMNS, failed, reason): one row for each row of `df`."""
    kind = dict(df.dtypes)[key]
    known = common_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                s = describe(part.column(1), known)
                none = s["some"] == 0
                made = [pa.array(s[c].astype(np.int64)) if t == "long" else pa.array(s[c], mask=none) for c, t in COLUMNS.items()]
                bad = failures(s)
                names = np.array(list(bad))
                flags = np.stack(list(bad.values()), 1)
                failed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flags.sum(1))]).astype(np.int32)), pa.array(names[np.nonzero(flags)[1]].tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *made, failed, pa.array(reasons(s).tolist(), pa.string())], names=[key, *COLUMNS, "failed", "reason"])

    ddl = ", ".join([f"{key} {kind}", *(f"{c} {t}" for c, t in COLUMNS.items()), "failed array<string>", "reason string"])
    return spread(df.select(key, text)).mapInArrow(run, ddl)
