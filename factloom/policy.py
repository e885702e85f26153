"""Relation policies: what kind of objects a relation has and how its samples are combined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Kind of objects, sample count, aggregation rule and thresholds of one relation."""

    kind: str
    rule: str
    samples: int
    candidate: float | None = None
    none: float | None = None
    completes: bool = False
    verifies: bool = False


# Relation names, kinds, rules, default sample counts and thresholds.
POLICIES = {
    "awardWonBy": Policy("string", "support", 20, candidate=0.05, completes=True),
    "companyTradesAtStockExchange": Policy("string", "threshold_none", 10, candidate=0.30, none=0.50),
    "countryLandBordersCountry": Policy("string", "union", 3, completes=True, verifies=True),
    "hasArea": Policy("numeric", "median", 20),
    "hasCapacity": Policy("numeric", "median", 15),
    "personHasCityOfDeath": Policy("string", "majority_none", 20, none=0.50),
}
RELATIONS = tuple(POLICIES)
NUMERIC = tuple(r for r, p in POLICIES.items() if p.kind == "numeric")
ABSTAINING = tuple(r for r, p in POLICIES.items() if p.none is not None)
CALIBRATABLE = tuple(r for r in ("personHasCityOfDeath", "companyTradesAtStockExchange", "awardWonBy"))
# Answers that say "no object" (compared after normalisation) and the numeric tolerance.
NONE_MARKERS = ("none", "null", "unknown", "no answer", "n/a")
TOLERANCE = 0.05


def by_relation(values: dict[str, object], relation: str | Column = "Relation", default: object = None) -> Column:
    """The value of a row's relation, as one expression."""
    rel = F.col(relation) if isinstance(relation, str) else relation
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(rel == name, F.lit(value)).otherwise(out)
    return out
