"""Checks of report parameters, made on the driver before a plan is built."""

from __future__ import annotations

from typing import Sequence

from spendscope.settings import REPORT_PLATFORMS


def choice(value: str, allowed: Sequence[str], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, got {value!r}")
    return value


def names(values: Sequence[str], name: str) -> list[str]:
    if isinstance(values, str):
        raise TypeError(f"{name} must be a list of strings, not one string")
    return [v.strip() for v in values]


def platforms(values: Sequence[str]) -> list[str]:
    return [choice(v, REPORT_PLATFORMS, "platforms") for v in names(values, "platforms")]


def clamped(value: float, low: float, high: float) -> float:
    return max(low, min(value, high))


def window_label(date_range: str, days: int) -> str:
    return f"{date_range} ({days} days)"
