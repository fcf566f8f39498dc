"""Platform pivots as aggregate columns; the caller groups.

One conditional aggregate per platform keeps the pivot in the same partial
aggregation as everything else: no extra shuffle and no distinct-values job.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendscope.functions import kpi


def _safe_name(platform: str) -> str:
    return re.sub(r"[^a-z0-9]", "_", platform.lower())


def _platform_sum(metric: str, platform: str) -> Column:
    return F.sum(F.when(F.col("platform") == platform, F.col(metric)))


def platform_pivot(metric: str, platforms: Sequence[str], precision: int = 2) -> list[Column]:
    return [
        kpi.rounded(_platform_sum(metric, p), precision).alias(f"{_safe_name(p)}_{metric}")
        for p in platforms
    ]


def platform_cpa_pivot(platforms: Sequence[str]) -> list[Column]:
    return [
        kpi.rounded(
            kpi.cpa(_platform_sum("spend", p), _platform_sum("conversions", p)), 2
        ).alias(f"{_safe_name(p)}_cpa")
        for p in platforms
    ]
