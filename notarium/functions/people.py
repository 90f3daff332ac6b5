"""Canonical names: lower case, dropped names out, aliases replaced, first occurrences kept."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F


class Aliases:
    """alias -> canonical name (both lower case), and names to drop."""

    def __init__(self, people: dict[str, dict | None], drop: list[str] = ()):
        self.canonical: dict[str, str] = {}
        self.drop = {d.lower() for d in drop}
        for name, entry in people.items():
            if name.startswith("_"):
                continue
            for alias in (name, *((entry or {}).get("aliases") or ())):
                owner = self.canonical.setdefault(alias.lower(), name.lower())
                if owner != name.lower():
                    raise ValueError(f"alias {alias!r} belongs to both {owner!r} and {name.lower()!r}")

    @classmethod
    def of(cls, spec: dict) -> Aliases:
        return cls({k: v for k, v in spec.items() if k != "_drop"}, spec.get("_drop") or [])


def canonical_people(people: Column, aliases: Aliases) -> Column:
    """The canonical array; null becomes empty."""
    lower = F.transform(F.coalesce(people, F.array().cast("array<string>")), F.lower)
    if aliases.drop:
        lower = F.filter(lower, lambda x: ~x.isin(sorted(aliases.drop)))
    if aliases.canonical:
        known = F.create_map(*map(F.lit, chain.from_iterable(sorted(aliases.canonical.items()))))
        lower = F.transform(lower, lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.array_distinct(lower)


def empty_as_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)
