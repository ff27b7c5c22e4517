"""Thresholds and empty-set conventions of pattern families.

Both are parameters of every mining operator and are never inferred from a program's name.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = {"floor": ROUND_FLOOR, "ceil": ROUND_CEILING, "round": ROUND_HALF_EVEN}
EMPTY_RULES = ("always", "never", "no_full_support_item", "some_item_frequent")


def absolute_threshold(sigma: float | str, n: int, side: str = "ceil") -> int:
    """max(1, sigma * n) brought to the given side, in exact decimal arithmetic."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {sorted(SIDES)}")
    return max(1, int((Decimal(str(sigma)) * n).to_integral_value(rounding=SIDES[side])))


def threshold_column(sigma: float | str, n: Column, side: str) -> Column:
    """absolute_threshold as a column over transaction counts, in integer arithmetic."""
    d = Decimal(str(sigma))
    p, q = d.as_integer_ratio()
    whole = F.floor((n * F.lit(p) - F.pmod(n * F.lit(p), F.lit(q))) / F.lit(q))
    rest = F.pmod(n * F.lit(p), F.lit(q))
    up = {"floor": F.lit(0), "ceil": (rest > 0).cast("long"), "round": ((2 * rest > q) | ((2 * rest == q) & (F.pmod(whole, F.lit(2)) == 1))).cast("long")}[side]
    return F.greatest(F.lit(1), whole + up).cast("long")


def emits_empty(rule: str, full_support_item: bool, some_item_frequent: bool) -> bool:
    """Whether a family's output holds the empty set (support |D|)."""
    if rule not in EMPTY_RULES:
        raise ValueError(f"rule must be one of {EMPTY_RULES}")
    return rule == "always" or (rule == "no_full_support_item" and not full_support_item) or (rule == "some_item_frequent" and some_item_frequent)
