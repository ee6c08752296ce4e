"""A text as read: case, accents, width, mark-up, escapes, invisible characters and spacing count for nothing."""

from __future__ import annotations

import html
import re
import sys
import unicodedata


def _class(categories: tuple[str, ...]) -> str:
    """A character class of all characters of the given Unicode categories, as ranges."""
    out, start, last = [], None, None
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in categories:
            if start is None:
                start = c
            last = c
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    if start is not None:
        out.append(f"\\U{start:08x}-\\U{last:08x}")
    return "[" + "".join(out) + "]+"


#: Marks and invisible characters, found once by a scan of all characters.
_UNSEEN = re.compile(_class(("Mn", "Me", "Cf")))
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>")
_WORD = re.compile("[a-z0-9]+")


def as_read(text: str) -> str:
    """The text in small letters without accents, tags, escapes and invisible characters; spacing is left as it stands."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold()
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)) if not text.isascii() else text
    return text.lower()


def read_words(text: str | None) -> list[str]:
    """The words of a text as read, in order; none for null."""
    return _WORD.findall(as_read(text)) if text else []
