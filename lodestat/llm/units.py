"""Texts as units between spaces, for tokenizers whose pieces never cross a space from the left.

A unit is looked up once for all that depends on it alone.  A space next to other white space is no
such border; texts that have one are handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Units that a worker keeps and their characters; beyond either the table starts anew (results do not change).
CACHE_UNITS, CACHE_CHARS, LONG_UNIT = 400_000, 24_000_000, 400

_RUNS = regex.compile(r" *[^ ]+| +$")


class Ragged(Exception):
    """The text cannot be cut at its spaces."""


class UnitTable(dict):
    """What a function gives for each unit, the space before it being part of the unit."""

    def __init__(self, function: Callable, lead: str):
        super().__init__()
        self.function, self.lead, self.chars = function, lead, 0

    def __missing__(self, unit: str):
        body = unit.lstrip(" ") if self.lead else unit
        if (body and (body[-1].isspace() or (self.lead and body[0].isspace()))) or (not self.lead and unit[:1] in ("", " ")):
            raise Ragged
        value = self.function(unit, self.lead)
        if len(unit) <= LONG_UNIT:
            if len(self) >= CACHE_UNITS or self.chars > CACHE_CHARS:
                self.clear()
                self.chars = 0
            self[unit] = value
            self.chars += len(unit)
        return value


def cut_units(text: str) -> tuple[str, list[str]]:
    """The first unit, and the others without one of the spaces before them."""
    units = text.split(" ")
    if "" in units:
        units = _RUNS.findall(text)
        return units[0], [u[1:] for u in units[1:]]
    return units[0], units[1:]


class Memo(dict):
    """A function's values; beyond its size the table starts anew."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        if len(self) >= CACHE_UNITS:
            self.clear()
        value = self.function(key)
        if len(key) <= LONG_UNIT:
            self[key] = value
        return value
