"""Named ranges of values and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds and names of contract value ranges.
VALUE_RANGES = ((100_000, "0-100K"), (500_000, "100K-500K"), (2_000_000, "500K-2M"), (None, "2M+"))
# Upper bounds and names of town sizes.
TOWN_SIZES = ((5_000, "micro"), (20_000, "pequeno"), (100_000, "medio"), (500_000, "grande"), (None, "metropole"))
# Most suppliers and name of each level of competition.
COMPETITION = ((3, "BAIXA"), (6, "MEDIA"), (11, "ALTA"), (None, "MUITO_ALTA"))


def bracket(c: Column, ranges: tuple[tuple[float | None, str], ...]) -> Column:
    """The first range whose bound exceeds the value; null for null."""
    out = F.when(c.isNull(), None)
    for bound, name in ranges:
        out = out.when(c < bound, name) if bound is not None else out.otherwise(name)
    return out
