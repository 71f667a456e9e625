"""Scalar text functions as column expressions; a Snowball English stemmer for distinct terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[a-z0-9_\-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- tokens ----------------------------------------------------------------


def raw_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-``."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))


def code_tokens(text: Column | str) -> Column:
    """Tokens as the code-aware tokenizer emits them, without stems.

    A compound token (one with ``_`` or ``-``) comes whole, then its parts;
    parts of one character are dropped.  Repeats are kept.
    """

    def parts(t: Column) -> Column:
        plain = F.when(F.length(t) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))
        own = F.filter(F.split(F.translate(t, "-", "_"), "_"), lambda p: F.length(p) > 1)
        return F.when(F.contains(t, F.lit("_")) | F.contains(t, F.lit("-")), F.concat(F.array(t), own)).otherwise(plain)

    return F.flatten(F.transform(F.coalesce(raw_tokens(text), F.array().cast("array<string>")), parts))


class Porter2:
    """The published Snowball English algorithm."""

    # fixed values of the algorithm
    VOWELS = set("aeiouy")
    DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
    LI = set("cdeghkmnrt")
    WHOLE = {
        "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
        "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    }
    STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
    STEP_2 = (
        ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
        ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
        ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
    )
    STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
    STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

    def regions(self, w: str) -> tuple[int, int]:
        def after(start: int) -> int:
            for i in range(start, len(w) - 1):
                if w[i] in self.VOWELS and w[i + 1] not in self.VOWELS:
                    return i + 2
            return len(w)

        r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
        r1 = after(0) if r1 is None else r1
        return r1, after(r1)

    def short_end(self, w: str) -> bool:
        if len(w) == 2:
            return w[0] in self.VOWELS and w[1] not in self.VOWELS
        return len(w) > 2 and w[-3] not in self.VOWELS and w[-2] in self.VOWELS and w[-1] not in self.VOWELS and w[-1] not in "wxY"

    def has_vowel(self, w: str) -> bool:
        return any(c in self.VOWELS for c in w)

    def stem(self, word: str) -> str:
        if len(word) <= 2:
            return word
        w = word.removeprefix("'")
        if w in self.WHOLE:
            return self.WHOLE[w]
        w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))
        r1, r2 = self.regions(w)
        for s in ("'s'", "'s", "'"):
            if w.endswith(s):
                w = w[: -len(s)]
                break
        w = self.plural(w)
        if w in self.STOP_AFTER_1A:
            return w.lower()
        w = self.past(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in self.VOWELS:
            w = w[:-1] + "i"
        w = self.suffixes(w, r1, r2)
        if w.endswith("e"):
            if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not self.short_end(w[:-1])):
                w = w[:-1]
        elif w.endswith("ll") and len(w) - 1 >= r2:
            w = w[:-1]
        return w.lower()

    def plural(self, w: str) -> str:
        if w.endswith("sses"):
            return w[:-2]
        if w.endswith(("ied", "ies")):
            return w[:-2] if len(w) > 4 else w[:-1]
        if w.endswith(("us", "ss")) or not w.endswith("s"):
            return w
        return w[:-1] if self.has_vowel(w[:-2]) else w

    def past(self, w: str, r1: int) -> str:
        for s in ("eedly", "eed"):
            if w.endswith(s):
                return w[: len(w) - len(s)] + "ee" if len(w) - len(s) >= r1 else w
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                base = w[: -len(s)]
                if not self.has_vowel(base):
                    return w
                if base.endswith(("at", "bl", "iz")):
                    return base + "e"
                if base.endswith(self.DOUBLES):
                    return base[:-1]
                return base + "e" if self.short_end(base) and r1 >= len(base) else base
        return w

    def suffixes(self, w: str, r1: int, r2: int) -> str:
        for s, new in self.STEP_2:
            if w.endswith(s):
                base = w[: -len(s)]
                if len(base) >= r1 and (s not in ("ogi", "li") or (s == "ogi" and base.endswith("l")) or (s == "li" and base and base[-1] in self.LI)):
                    w = base + new
                break
        for s, new in self.STEP_3:
            if w.endswith(s):
                base = w[: -len(s)]
                if len(base) >= r1 and (s != "ative" or len(base) >= r2):
                    w = base + new
                break
        for s in self.STEP_4:
            if w.endswith(s):
                base = w[: -len(s)]
                if len(base) >= r2 and (s != "ion" or (base and base[-1] in "st")):
                    w = base
                break
        return w


def stem_word(word: str) -> str:
    return Porter2().stem(word)


@F.pandas_udf(T.StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column of distinct terms (call it on a vocabulary, not on every occurrence)."""
    p = Porter2()
    for s in words:
        yield s.map(lambda w: None if w is None else p.stem(w))


def remembered_stems(most: int = 500_000):
    """``stem_word`` that remembers at most so many words, for texts that are read a token at a time."""
    return lru_cache(most)(Porter2().stem)


def tokenize(text: str) -> list[str]:
    """The tokenizer for query strings on the driver: compounds, parts, and stems that differ."""
    import re

    out = []
    for t in re.findall(TOKEN, text.lower()):
        if "_" in t or "-" in t:
            out.append(t)
        for p in re.split(r"[_\-]", t):
            if len(p) > 1:
                out.append(p)
                if (s := stem_word(p)) != p:
                    out.append(s)
    return out


# ---- ids and names -----------------------------------------------------------


def path_to_id(path: Column | str) -> Column:
    """``concepts/a.md`` to ``wiki:concepts:a``."""
    return F.concat(F.lit("wiki:"), F.replace(F.regexp_replace(_col(path), r"\.md$", ""), F.lit("/"), F.lit(":")))


def id_to_path(page_id: Column | str) -> Column:
    return F.concat(F.replace(F.regexp_replace(_col(page_id), "^wiki:", ""), F.lit(":"), F.lit("/")), F.lit(".md"))


def base_id(page_id: Column | str) -> Column:
    """An id without its section anchor."""
    return F.substring_index(_col(page_id), "#", 1)


def section_id(page_id: Column | str, header: Column | str) -> Column:
    return F.concat(_col(page_id), F.lit("#"), F.replace(F.lower(_col(header)), F.lit(" "), F.lit("-")))


def slugify(text: Column | str) -> Column:
    """Lower-case letters, digits, ``_`` and single ``-``."""
    dashed = F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_-]", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def truncate(text: Column | str, limit: int) -> Column:
    c = _col(text)
    return F.when(F.octet_length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def xml_escape(text: Column | str) -> Column:
    c = _col(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def template_variables(text: Column | str) -> Column:
    """Sorted distinct names in ``{{name}}``."""
    found = F.regexp_extract_all(_col(text), F.lit(r"\{\{\s*(.*?)\s*\}\}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v != "")))


# ---- markup ----------------------------------------------------------------


def unfenced_lines(text: Column | str) -> Column:
    """Lines outside ``` blocks; an unclosed block runs to the end."""
    fenced = r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)"
    return F.split(F.regexp_replace(_col(text), fenced, ""), "\n")


def wikilinks(text: Column | str) -> Column:
    """Targets of ``[[target]]`` and ``[[target|label]]``, distinct in order."""
    found = F.regexp_extract_all(_col(text), F.lit(r"\[\[([^\]]+?)(?:\|[^\]]+)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""))


def inline_tags(text: Column | str) -> Column:
    """``#tags`` of more than one character outside fences and second-level headers."""
    lines = F.filter(unfenced_lines(text), lambda x: ~F.startswith(F.ltrim(x), F.lit("## ")))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?:^|\s)#([a-zA-Z][\w-]*)"), F.lit(1))))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def references(text: Column | str) -> Column:
    r"""``@wiki/type/path`` references outside fences, as ``type/path``."""
    found = F.flatten(F.transform(unfenced_lines(text), lambda x: F.regexp_extract_all(x, F.lit(r"\B@wiki/([A-Za-z0-9_-]+/[A-Za-z0-9_./-]+)"), F.lit(1))))
    return F.transform(found, lambda r: F.regexp_replace(r, r"[.]+$", ""))


# ---- durations -------------------------------------------------------------


def duration_minutes(text: Column | str) -> Column:
    """Minutes of ``"1h 30m"``: what stands before the first ``h``, and after the last, as numbers.

    A bare number is read both ways, so ``"2"`` is 122 minutes (Q16); text that
    is no number adds nothing.
    """
    c = F.trim(F.coalesce(_col(text), F.lit("")))
    hours = F.trim(F.substring_index(c, "h", 1)).try_cast("double")
    minutes = F.regexp_replace(F.trim(F.substring_index(c, "h", -1)), "m+$", "").try_cast("double")
    return F.coalesce(hours * 60, F.lit(0.0)) + F.coalesce(minutes, F.lit(0.0))


def duration_hours(text: Column | str) -> Column:
    """The number before the first ``h``, as time reports sum it."""
    return F.trim(F.substring_index(F.coalesce(_col(text), F.lit("")), "h", 1)).try_cast("double")


def duration_whole_minutes(text: Column | str) -> Column:
    """Whole minutes of ``"1h 30m"`` as tasks add them up: digits before the first ``h``, and between the last ``h`` and the first ``m``."""
    c = F.lower(F.trim(F.coalesce(_col(text), F.lit(""))))
    whole = lambda x: F.when(F.rlike(F.trim(x), F.lit(r"^\+?[0-9]+$")), F.trim(x).try_cast("bigint"))
    hours = F.when(F.contains(c, F.lit("h")), whole(F.substring_index(c, "h", 1)))
    # an "m" before the last "h" leaves nothing between them
    minutes = F.when(F.contains(c, F.lit("m")) & (F.instr(c, "m") > F.length(c) - F.instr(F.reverse(c), "h") + 1 - F.when(F.contains(c, F.lit("h")), 0).otherwise(F.length(c) + 1)), whole(F.substring_index(F.substring_index(c, "h", -1), "m", 1)))
    return F.coalesce(hours * 60, F.lit(0)) + F.coalesce(minutes, F.lit(0))


def format_duration(minutes: Column | str) -> Column:
    m = F.floor(_col(minutes)).cast("long")
    return F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))
