"""Settings as intervals, written the way mathematics writes them: '[1, inf) whole', '(0, 1]', '[0, inf] or none'.

A bracket holds its end, a parenthesis does not.  A value in an interval is given back as a plain int or float, so
decimals, fractions and NumPy numbers go no further than the entry point.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from fractions import Fraction
from typing import Any

_WRITTEN = re.compile(r"(?P<open>[\[(])(?P<low>[^,]+),(?P<high>[^\])]+)(?P<close>[\])])(?P<whole> whole)?(?P<none> or none)?")


class Interval:
    def __init__(self, written: str):
        m = _WRITTEN.fullmatch(written)
        if m is None:
            raise ValueError(f"not an interval: {written!r}")
        self.written, self.whole, self.none = written, m["whole"] is not None, m["none"] is not None
        self.ends = tuple(float(m[end]) for end in ("low", "high"))
        self.held = tuple(end for end, closed in zip(self.ends, (m["open"] == "[", m["close"] == "]"), strict=True) if closed)

    def __repr__(self) -> str:
        return self.written

    def native(self, value: Any) -> int | float | None:
        """value as a plain number; ValueError where it is not in the interval, TypeError where it is no number."""
        if value is None and self.none:
            return None
        number = _plain(value, self.whole)
        low, high = self.ends
        if not (low < number < high or number in self.held):
            raise ValueError(f"{value!r} is not in {self}")
        return number


def _plain(value: Any, whole: bool) -> int | float:
    """An int or float of the same size.  Booleans, text and arrays are no numbers, nor is anything without a size.

    A number that is not zero must not become zero: it would change sides of an open end.
    """
    if isinstance(value, bool | str | bytes) or type(value).__name__ == "bool_" or getattr(value, "shape", ()) != ():
        raise TypeError(f"{value!r} is no number")
    if whole:
        if not hasattr(value, "__index__"):
            raise TypeError(f"{value!r} is no whole number")
        return int(value)
    if not hasattr(value, "__float__"):
        raise TypeError(f"{value!r} is no number")
    if isinstance(value, int):
        return value
    try:
        number = float(value)
    except (ValueError, OverflowError) as e:
        raise TypeError(f"{value!r} is no number: {e}") from None
    if math.isnan(number) or number == 0 and Fraction(value) != 0:
        raise TypeError(f"{value!r} has no size as a float")
    return number


def checked(owner: str, intervals: Mapping[str, str], given: Mapping[str, Any]) -> dict[str, Any]:
    """given with plain numbers for the settings that have an interval; ValueError names the first that is not allowed."""
    out = dict(given)
    for name, written in intervals.items():
        try:
            out[name] = Interval(written).native(given[name])
        except (TypeError, ValueError) as e:
            raise ValueError(f"{owner}: {name} must be in {written}; {e}") from None
    return out
