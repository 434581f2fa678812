"""Open numeric intervals for the length and quality filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Interval:
    """Strictly between `low` and `high`: neither bound belongs to it. A reversed interval holds nothing."""

    low: float = -math.inf
    high: float = math.inf

    @classmethod
    def parse(cls, text: str) -> Interval:
        parts = [p.strip() for p in text.lower().split(",")]
        if len(parts) != 2:
            raise ValueError(f"an interval needs a minimum and a maximum: {text!r}")
        bounds = []
        for name, part in zip(("minimum", "maximum"), parts, strict=True):
            try:
                if "_" in part:
                    raise ValueError
                bounds.append(float(part))
            except ValueError:
                raise ValueError(f"the {name} of an interval is not a number: {part!r}") from None
        return cls(*bounds)

    @classmethod
    def of(cls, x: Interval | str | tuple[float, float]) -> Interval:
        return x if isinstance(x, Interval) else cls.parse(x) if isinstance(x, str) else cls(*map(float, x))

    def contains(self, col: Column) -> Column:
        """A NaN value is in no interval; a NaN bound lets nothing pass (Spark orders NaN above all numbers)."""
        from pyspark.sql import functions as F

        if math.isnan(self.low) or math.isnan(self.high):
            return F.lit(False)
        x = col.cast("double")
        return ~F.isnan(x) & (x > F.lit(self.low)) & (x < F.lit(self.high))
