"""Text functions on columns (and their driver-side twins for single query strings)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separator of flattened lists.
LIST_SEPARATOR = " | "


def normalize_text(value: Column) -> Column:
    """Lower-case, every run of characters outside a-z and 0-9 one space; edge spaces stay. Null gives ''."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), "[^a-z0-9]+", " ")


def normalize_for_search(value: Column) -> Column:
    """Unicode letters and digits in lower case, other runs one space, trimmed. Null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))


def search_form(text: str | None) -> str:
    """Driver-side twin of normalize_for_search."""
    kept = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in (text or "").lower())
    return " ".join(kept.split())


def tokens_of(text: str | None) -> list[str]:
    return search_form(text).split()


def tokens(value: Column) -> Column:
    form = normalize_for_search(value)
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))


def clean(value: Column) -> Column:
    """Trim, strip double quotes at the ends, collapse white space. Null gives ''."""
    one = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " ")
    return F.trim(F.regexp_replace(F.trim(one), r'^"+|"+$', ""))


def clean_cell(text: str | None) -> str:
    return " ".join((text or "").split()).strip('"').strip()


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def house_number(address: Column) -> Column:
    """Leading number with at most one letter, '' when there is none. Null gives ''."""
    return F.regexp_extract(F.lower(F.coalesce(address.cast("string"), F.lit(""))), r"^\s*([0-9]+[a-z]?)", 1)


def postcode_digits(value: Column) -> Column:
    """First five digits of a postcode, '' when there are none."""
    return F.left(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9]", ""), F.lit(5))


def join_non_blank(separator: str, *parts: Column) -> Column:
    """Non-blank parts joined; null when all are blank or null."""
    return F.nullif(F.concat_ws(separator, *[blank_to_null(p.cast("string")) for p in parts]), F.lit(""))


def contains_all_tokens(haystack: Column, query_tokens: Iterable[str]) -> Column:
    """True if every token is a substring; false without tokens. ``contains`` has no wildcards to escape."""
    test = None
    for token in query_tokens:
        hit = haystack.contains(token)
        test = hit if test is None else test & hit
    return F.lit(False) if test is None else test


def first_existing(df: DataFrame, aliases: Iterable[str], default: str | None = "") -> Column:
    """The first of the aliases that is a column of df (case-insensitive; 'a.b' looks into a struct), else a literal."""
    found = first_existing_name(df, aliases)
    return F.col(found).cast("string") if found else F.lit(default).cast("string")


def first_existing_name(df: DataFrame, aliases: Iterable[str]) -> str | None:
    by_lower = {f.name.lower(): f for f in df.schema.fields}
    for alias in aliases:
        head, _, rest = alias.partition(".")
        field = by_lower.get(head.lower())
        if field is None:
            continue
        if not rest:
            return f"`{field.name}`"
        names = {n.lower(): n for n in getattr(field.dataType, "names", None) or []}
        if rest.lower() in names:
            return f"`{field.name}`.`{names[rest.lower()]}`"
    return None


def sanitize_name(text: str | None, fallback: str = "Output", limit: int = 50) -> str:
    """A dataset name: letters, digits and underscores, each run of the rest one underscore, none at the ends, the fallback if
    nothing is left, prefixed where it doesn't begin with a letter, cut to limit."""
    name = re.sub(r"[^\w]+", "_", text or "").strip("_") or fallback
    return (name if name[0].isalpha() else "fc_" + name)[:limit].rstrip("_")
