"""Text functions whose semantics differ from the built-ins: Unicode trim, previews, search terms, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# What counts as white space when trimming (Unicode spaces and the byte order mark).
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# File extensions and their formats.
FORMATS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "txt": "text"}
# Characters of comments that are only reactions.
_REACTION = (
    r"\A[" + SPACES + r"\p{So}+\-!?.,:;'\"()\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]+\z"
)
NOISE_BELOW = 50


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def file_format(path: Column) -> Column:
    """markdown, pdf or text by extension, null for others."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for name, format_ in FORMATS.items():
        out = F.when(ext == name, format_).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def search_terms(search: str | None) -> list[str]:
    return re.split(r"\s+", search.strip()) if search and search.strip() else []


def like_pattern(term: str) -> str:
    """A term as a substring pattern; % and _ in it stay wildcards, a backslash is taken literally."""
    return "%" + term.replace("\\", "\\\\") + "%"


def is_noise(body: Column) -> Column:
    """Comments that are too short to matter, or reactions only."""
    trimmed = trim_all(body)
    return (F.char_length(trimmed) < NOISE_BELOW) | F.rlike(trimmed, F.lit(_REACTION))


def identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "_")


def split_list(text: Column) -> Column:
    """Entries of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), trim_all), lambda x: x != "")


def joined_or(items: Column, separator: str, fallback: str) -> Column:
    """Items joined, or the fallback when there are none."""
    return F.coalesce(F.nullif(F.array_join(items, separator), F.lit("")), F.lit(fallback))


def percent(share: Column) -> Column:
    return F.format_number(share * 100, 1)


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def embed_text(domain: Column, category: Column, key: Column, value: Column, context: Column, backfill: bool = False) -> Column:
    """What is embedded for a fact: where it belongs, key and value, and its context on a line of its own.

    A save leaves an empty context out; a backfill leaves only a null one out.
    """
    there = context.isNotNull() if backfill else F.coalesce(context, F.lit("")) != ""
    return F.concat(domain, F.lit("/"), category, F.lit(" - "), key, F.lit(": "), value, F.when(there, F.concat(F.lit("\n"), context)).otherwise(F.lit("")))
