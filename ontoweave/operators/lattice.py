"""The lattice of property constraints.

``meet`` and ``refines`` are plain functions over one pair, for grouped folds whose order matters; ``meet_bounds`` is the same for
cardinalities as partial aggregates, for tables of any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.errors import MeetError


@dataclass(frozen=True)
class Constraint:
    prop_iri: str
    label: str | None = None
    annotations: tuple[str, ...] = ()
    ranges: tuple[str, ...] = ()
    min_card: int = 0
    max_card: int | None = None
    allowed_values: tuple[str, ...] = ()
    source: str = "domain"
    is_symmetric: bool = False
    is_transitive: bool = False
    is_inverse_functional: bool = False

    @property
    def is_bottom(self) -> bool:
        return self.max_card is not None and self.min_card > self.max_card

    @property
    def is_top(self) -> bool:
        return not self.ranges and not self.min_card and self.max_card is None and not self.allowed_values

    def meaning(self) -> tuple:
        """What two constraints of one meaning share."""
        return self.prop_iri, frozenset(self.ranges), self.min_card, self.max_card, frozenset(self.allowed_values)


def top(iri: str, label: str | None = None) -> Constraint:
    return Constraint(iri, label)


def bottom(iri: str, label: str | None = None) -> Constraint:
    return Constraint(iri, label, min_card=1, max_card=0, source="refined")


@dataclass
class Hierarchy:
    """Ancestors (with themselves) and disjoint pairs of the classes of an ontology; small enough for a task's memory."""

    ancestors: dict[str, frozenset[str]] = field(default_factory=dict)
    disjoint: frozenset = frozenset()

    def subclass(self, a: str, b: str) -> bool:
        return a == b or b in self.ancestors.get(a, ())

    def relation(self, a: str, b: str) -> str:
        above_a, above_b = {a, *self.ancestors.get(a, ())}, {b, *self.ancestors.get(b, ())}
        if any((x, y) in self.disjoint or (y, x) in self.disjoint for x in above_a for y in above_b):
            return "Disjoint"
        return "Overlapping" if b in above_a or a in above_b else "Unknown"


def simplify(ranges, h: Hierarchy) -> tuple[str, ...]:
    """Nothing if two exclude each other; else without ranges that another one is a strict subclass of, sorted."""
    ranges = sorted(set(ranges))
    if any(h.relation(a, b) == "Disjoint" for i, a in enumerate(ranges) for b in ranges[i + 1 :]):
        return ()
    return tuple(r for r in ranges if not any(s != r and h.subclass(s, r) and not (h.subclass(r, s) and s > r) for s in ranges))


def intersect_ranges(a, b, h: Hierarchy) -> tuple[str, ...]:
    a, b = (simplify(x, h) for x in (a, b))
    if not a or not b:
        return a or b
    if both := set(a) & set(b):
        return tuple(sorted(both))
    kinds = {h.relation(x, y) for x in a for y in b}
    return () if "Disjoint" in kinds and "Overlapping" not in kinds else simplify({*a, *b}, h)


def intersect_values(a, b) -> tuple[str, ...]:
    """Common values; of values without a common one their union (kept as a convention); empty means any."""
    if not a or not b:
        return tuple(sorted(set(a or b)))
    return tuple(sorted(set(a) & set(b) or {*a, *b}))


def least_bound(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def meet(a: Constraint, b: Constraint, h: Hierarchy) -> Constraint:
    """The weakest constraint that implies both.  Keeps the label (a departure, see README); flags are those both have."""
    if a.prop_iri != b.prop_iri:
        raise MeetError(f"{a.prop_iri} and {b.prop_iri} are different properties")
    if a.meaning() == b.meaning():
        return a
    if a.is_bottom or b.is_bottom:
        return bottom(a.prop_iri, a.label or b.label)
    if a.is_top or b.is_top:
        return b if a.is_top else a
    ranges = intersect_ranges(a.ranges, b.ranges, h)
    low, high = max(a.min_card, b.min_card), least_bound(a.max_card, b.max_card)
    if (high is not None and low > high) or (not ranges and a.ranges and b.ranges):
        return bottom(a.prop_iri, a.label or b.label)
    return Constraint(a.prop_iri, a.label or b.label, tuple(sorted({*a.annotations, *b.annotations})), ranges, low, high, intersect_values(a.allowed_values, b.allowed_values), "refined")


def refines(a: Constraint, b: Constraint, h: Hierarchy) -> bool:
    """a is at least as strict as b (allowed values aside)."""
    if a.prop_iri != b.prop_iri:
        return False
    if a.is_bottom or b.is_top:
        return True
    if a.is_top or b.is_bottom:
        return False
    high = b.max_card is None or (a.max_card is not None and a.max_card <= b.max_card)
    return high and a.min_card >= b.min_card and all(any(h.subclass(x, r) for x in a.ranges) for r in b.ranges)


def fold(constraints, h: Hierarchy) -> Constraint:
    """Meet of several, in order; a pair that can't meet keeps the later one."""
    out = None
    for c in constraints:
        try:
            out = c if out is None else meet(out, c, h)
        except MeetError:
            out = c
    return out


def with_source(c: Constraint, source: str) -> Constraint:
    return replace(c, source=source)


def meet_bounds(rows: DataFrame, *by: str) -> DataFrame:
    """min_card, max_card and is_bottom of the meet of all rows (min_card, max_card) of a group; null max is unbounded."""
    return rows.groupBy(*by).agg(F.coalesce(F.max("min_card"), F.lit(0)).alias("min_card"), F.min("max_card").alias("max_card")).withColumn("is_bottom", F.coalesce(F.col("min_card") > F.col("max_card"), F.lit(False)))


def bounds_refine(prefix_a: str = "a", prefix_b: str = "b"):
    """Column: the bounds of a lie within those of b."""
    low = F.col(f"{prefix_a}_min") >= F.col(f"{prefix_b}_min")
    high = F.col(f"{prefix_b}_max").isNull() | (F.col(f"{prefix_a}_max") <= F.col(f"{prefix_b}_max"))
    return F.coalesce(low & high, F.lit(False))
