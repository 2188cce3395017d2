"""Argument checks of the query surface, before any plan is built."""

from __future__ import annotations

import math
from typing import Any


def non_negative_int(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value != int(value) or value < 0:
        raise ValueError(f"{name} must be a non-negative integer")
    return int(value)


def clamp_int(value: Any, least: int, most: int, name: str, fallback: int) -> int:
    """value cut to whole numbers and to the range; fallback where it is missing."""
    if value is None:
        return fallback
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return max(least, min(most, int(value)))


def replay_arguments(around: Any, window: Any = None) -> tuple[int, int]:
    return non_negative_int(around, "around"), 5 if window is None else non_negative_int(window, "window")


def parse_flags(argv: list[str]) -> tuple[list[str], dict[str, str | bool]]:
    """(positional, flags) of --key=value, --key and plain arguments."""
    positional, flags = [], {}
    for a in argv:
        if a.startswith("--"):
            key, equals, value = a[2:].partition("=")
            flags[key] = value if equals else True
        else:
            positional.append(a)
    return positional, flags
