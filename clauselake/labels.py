"""Classes, families, severities and constants of the results model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("limitation_of_liability", "contract_by_using", "unilateral_change", "arbitration", "content_removal", "choice_of_law", "other", "unilateral_termination", "jurisdiction")
OTHER = CATEGORIES.index("other")
UNFAIR = tuple(c for c in CATEGORIES if c != "other")
FAMILIES = ("rights", "liability", "control", "consent", "money")
FAMILY_OF = {
    "arbitration": "rights",
    "jurisdiction": "rights",
    "choice_of_law": "rights",
    "limitation_of_liability": "liability",
    "unilateral_change": "control",
    "unilateral_termination": "control",
    "content_removal": "control",
    "contract_by_using": "consent",
}
MONEY_KINDS = ("auto_renewal", "cancellation_fee", "no_refund", "price_change")
SEVERITY_OF = {
    "arbitration": "high",
    "unilateral_termination": "high",
    "cancellation_fee": "high",
    "limitation_of_liability": "medium",
    "unilateral_change": "medium",
    "content_removal": "medium",
    "jurisdiction": "medium",
    "auto_renewal": "medium",
    "no_refund": "medium",
    "price_change": "medium",
    "choice_of_law": "low",
    "contract_by_using": "low",
}
SEVERITY_POINTS = {"high": 25, "medium": 12, "low": 4}
RULE_CONFIDENCE, MOST_POINTS, MOST_MONEY, MOST_PASSAGES = 0.9, 5, 200, 500
TTL_DAYS = 30


def lookup(values: dict, key: Column) -> Column:
    """A small dictionary as a column; null for a key that it has not."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def is_unfair(category: Column) -> Column:
    return F.coalesce(category.isin(*UNFAIR), F.lit(False))


def family(category: Column) -> Column:
    return F.when(category.isin(*MONEY_KINDS), "money").otherwise(lookup(FAMILY_OF, category))


def severity(kind: Column) -> Column:
    return lookup(SEVERITY_OF, kind)


def severity_points(severity_: Column) -> Column:
    return lookup(SEVERITY_POINTS, severity_)


def level(score: Column) -> Column:
    return F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")
