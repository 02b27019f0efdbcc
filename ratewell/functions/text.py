"""Text expressions for labels, headers and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+))"


def token(text: Column | str, sep: str, position: int) -> Column:
    """The ``position``-th piece of ``text``; negative counts from the end, NULL if absent."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(text, re.escape(sep))
    return F.try_element_at(pieces, F.lit(position))


def first_number(text: Column | str) -> Column:
    """First number in a text as double, thousands commas removed, NULL if none."""
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 1), ",", "")
    return digits.try_cast("double")


def half_unit(number: Column | str) -> Column:
    """Two-digit whole numbers ending in 5 lost their dot: 85 means 8.5."""
    number = F.col(number) if isinstance(number, str) else number
    lost_dot = (number >= 10) & (number < 100) & (number % 10 == 5)
    return F.when(lost_dot, number / 10).otherwise(number).cast("double")


def strip_replicate(label: Column | str) -> Column:
    """Remove every dot followed by one digit, as left by numbering duplicates."""
    return F.regexp_replace(label, r"\.[0-9]", "")


def contains_any(text: Column | str, needles: list[str]) -> Column:
    """Case-insensitive literal substring test against several needles."""
    low = F.lower(text)
    found = F.lit(False)
    for needle in needles:
        found = found | low.contains(needle.lower())
    return found


def first_match(text: Column | str, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Class of the first ``(pattern, class)`` rule that matches."""
    text = F.col(text) if isinstance(text, str) else text
    chain = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        chain = chain.when(text.rlike(pattern), name)
    return chain.otherwise(F.lit(default))


def clean_names(names: list[str]) -> list[str]:
    """Lower snake case header names; repeats get ``_2``, ``_3``."""
    cleaned: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
        base = re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower() or "x"
        base = f"x{base}" if base[0].isdigit() else base
        seen[base] = seen.get(base, 0) + 1
        cleaned.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return cleaned
