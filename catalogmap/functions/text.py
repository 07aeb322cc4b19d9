"""Column expressions on text and JSON maps."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogmap.functions.stopwords import ENGLISH

# Patterns and cut lengths.
TAG = r"<[^>]+>"
SPACE = r"(?U)\s+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
NAME_CUT = 60


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(c: str | Column) -> Column:
    """Every run of Unicode white space becomes one blank; none stays at the ends."""
    return F.trim(F.regexp_replace(col_of(c), SPACE, " "))


def strip_tags(c: str | Column) -> Column:
    return F.regexp_replace(col_of(c), TAG, " ")


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_html(c: str | Column) -> Column:
    """Strip tags, then resolve entities, then collapse white space; null becomes ''."""
    return collapse_space(unescape_entities(strip_tags(F.coalesce(col_of(c), F.lit("")))))


def tokens(c: str | Column) -> Column:
    """Lower-case word runs of two characters or more."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(TOKEN), F.lit(0))


def space_tokens(c: str | Column) -> Column:
    """Lower-case words split at white space."""
    trimmed = F.lower(collapse_space(c))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, " ")).otherwise(F.array().cast("array<string>"))


def terms(c: str | Column, stop_words: Sequence[str] = ENGLISH, bigrams: bool = True) -> Column:
    """Tokens without stop words, then the neighbouring pairs of what is left."""
    words = tokens(c)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    if not bigrams:
        return words
    # the one-element transform binds the filtered array once, so it is not computed three times
    both = F.transform(
        F.array(words),
        lambda a: F.concat(
            a,
            F.zip_with(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
                lambda x, y: F.concat(x, F.lit(" "), y),
            ),
        ),
    )
    return both[0]


def top_key(m: str | Column) -> Column:
    """Key with the greatest count; the first key wins a tie; null without any count."""
    entries = F.filter(F.map_entries(col_of(m)), lambda e: e["value"].isNotNull())
    best = F.aggregate(
        entries,
        F.lit(None).cast("struct<key:string,value:bigint>"),
        lambda acc, e: F.when(acc.isNull() | (e["value"] > acc["value"]), e).otherwise(acc),
    )
    return best["key"]


def parse_label_reply(c: str | Column) -> tuple[Column, Column]:
    """(name, description) of a model's reply in the form ``NAME: …`` / ``DESC: …``.

    Emphasis marks are dropped. A reply without a name gives its first line, cut short.
    """
    text = F.coalesce(col_of(c), F.lit(""))
    text = F.regexp_replace(text, r"\*\*|__", "")
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    name_found = F.rlike(text, F.lit(r"(?U)NAME:\s*[^\n]"))
    name = F.regexp_extract(text, r"(?U)NAME:\s*([^\n]+)", 1)
    first_line = F.substring(F.substring_index(text, "\n", 1), 1, NAME_CUT)
    desc = F.regexp_extract(text, r"(?sU)DESC:\s*(.+)", 1)
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return strip(F.when(name_found, name).otherwise(first_line)), strip(desc)


def rating_digit(c: str | Column) -> Column:
    """First of the digits 1, 2, 3 in a reply, as an integer; null when there is none."""
    return F.nullif(F.regexp_extract(col_of(c), "[123]", 0), F.lit("")).try_cast("int")
