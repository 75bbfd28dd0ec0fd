"""Text column functions (JVM expressions, no Python in the row path)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: What counts as part of a word everywhere in this library.
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Unicode white space, written so that Java and RE2 read it alike.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def slugify(text: Column) -> Column:
    """Lower-case, runs of other than a-z0-9 become ``-``, outer ``-`` removed; null gives ''."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(body, "^-+|-+$", "")


def normalized_id(name: Column, label: Column) -> Column:
    """``slug::label``, the id of a graph node."""
    return F.concat(slugify(name), F.lit("::"), label)


def strip(text: Column) -> Column:
    """Trim Unicode white space (``trim`` alone removes only blanks)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.regexp_replace(text, SPACE + "+", "") == "", F.lit(True))


def alnum_key(text: Column) -> Column:
    """Only letters and digits, lower-cased; accents stay, null stays null."""
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Case-insensitive substring match of any literal keyword; no keywords keeps all rows."""
    if not keywords:
        return F.lit(True)
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    return text.rlike("(?iu)" + quoted)


def context_snippet(text: Column, name: Column, max_chars: int = 200) -> Column:
    """Characters around the first case-insensitive hit of ``name``, else the head of ``text``.

    The window starts half of ``max_chars`` before the hit (at 0 at the earliest) and ends
    half of it after the hit's end. Null or empty text gives ''.
    """
    half = max_chars // 2
    hit = F.call_function("instr", F.lower(text), F.lower(name))
    start = F.greatest(hit - 1 - half, F.lit(0))
    end = hit - 1 + F.length(name) + half
    around = F.substring(text, start + 1, end - start)
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "")
        .when(F.coalesce(hit, F.lit(0)) > 0, around)
        .otherwise(F.substring(text, 1, max_chars))
    )


def html_unescape(text: Column) -> Column:
    """The five basic entities and &nbsp;, ``&amp;`` last so that nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape_all(text: Column) -> Column:
    """All named and numeric entities of HTML 5; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)
