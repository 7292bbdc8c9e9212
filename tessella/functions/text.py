"""Text expressions: white space, clipping, names, hashes, chunks."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What models write for "absent". Compared trimmed and lower-cased.
ABSENT = ("", "n/a", "not available", "not found", "not specified", "not stated", "null")
SAMPLE_MAX = 80


def collapse(c: Column) -> Column:
    """ST2: runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{FEFF}]+", " "))


def clip(c: Column, most: int = SAMPLE_MAX) -> Column:
    """ST6: collapsed and cut to ``most`` code points, the last an ellipsis."""
    s = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def field_label(c: Column) -> Column:
    """ST7: underscores become blanks; trimmed."""
    return F.trim(F.regexp_replace(c, "_+", " "))


def field_key(c: Column) -> Column:
    """ST7: what field names are compared by; null for blanks and names that start with @."""
    key = F.trim(F.regexp_replace(F.lower(field_label(c)), r"[_\s]+", " "))
    return F.when((key != "") & ~key.startswith("@"), key)


def canonical_number(c: Column) -> Column:
    """ST5: the first digit run with decimals, commas removed; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"\d+(?:\.\d+)?", 0)


def absent_to_null(c: Column) -> Column:
    """ST11."""
    return F.when(~F.lower(F.trim(c)).isin(*ABSENT), c)


def fence_stripped(c: Column) -> Column:
    """ST10: a model's answer without its code fence."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*```(?:json)?", ""), r"(?i)```\s*$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def table_cell(c: Column) -> Column:
    """ST9: a value in a Markdown table; null becomes none."""
    return F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("none")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def truncated_prompt(content: Column, limit: int) -> Column:
    """ST13: content cut to the limit, with a note that it was."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("\n\n[content cut here]"))).otherwise(content)


def short_md5(c: Column) -> Column:
    """HK1: twelve hex digits."""
    return F.substring(F.md5(c), 1, 12)


_MARKS = re.compile(r"\s+")


def normalise(text: str) -> str:
    """ST4: compatibility form without marks, lower case, white space collapsed."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M")
    return _MARKS.sub(" ", plain.lower()).strip()


_CUT = re.compile(r"(?m)^(?=#{1,3}\s)")
_HEADING = re.compile(r"#{1,3}\s+(.+)")


def chunk_text(text: str | None, size: int, overlap: int = 200) -> list[dict]:
    """ST1: chunks cut before headings of level 1 to 3.

    A chunk ends when the next section would take it over ``size``; the next begins with its last
    ``overlap`` code points. ``section`` is the last heading seen, which is that of the section that
    didn't fit any more. The hash is of the chunk before it is trimmed. A long section isn't split.
    """
    if not text or size <= 0:
        return []
    cuts = sorted({0, len(text), *(m.start() for m in _CUT.finditer(text))})
    out: list[dict] = []
    held, heading = "", None

    def give() -> None:
        t = held.strip()
        out.append({"text": t, "index": len(out), "section": heading, "charCount": len(t), "hash": hashlib.md5(held.encode("utf-8", "surrogatepass")).hexdigest()[:12]})

    for a, b in zip(cuts, cuts[1:], strict=False):
        section = text[a:b]
        if m := _HEADING.match(section):
            heading = m[1].strip()
        if held and len(held) + len(section) > size:
            give()
            held = (held[-overlap:] if overlap > 0 else "") + section
        else:
            held += section
    if held.strip():
        give()
    return out
