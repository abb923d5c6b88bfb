"""Canonical spellings and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical transaction types.
TXN_TYPES = ("TRANSFER", "CARD_PAYMENT", "ATM_WITHDRAWAL", "INBOUND_CREDIT", "OUTBOUND_PAYMENT")

# The canonical archetypes.
ARCHETYPES = (
    "salary_worker",
    "student",
    "small_business",
    "hf_merchant",
    "traveler",
    "family",
    "spending_surge",
    "high_volume_business",
)


def col(name: str) -> Column:
    """The column of that very name, also when the name has dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def canonical(c: Column, upper: bool) -> Column:
    """Letter case, surrounding blanks and separators (blank, hyphen, underscore) brought to one form."""
    trimmed = F.regexp_replace(c, r"^[\s_\-]+|[\s_\-]+$", "")
    joined = F.regexp_replace(trimmed, r"[\s_\-]+", "_")
    return F.upper(joined) if upper else F.lower(joined)


def code_of(c: Column, values: tuple[str, ...], upper: bool) -> Column:
    """Position of the canonical value in values, from 0; NULL for any other. Already canonical text takes no regex."""
    exact, loose = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(values):
        exact, loose = exact.when(c == v, i), loose.when(canonical(c, upper) == v, i)
    return F.coalesce(exact, loose)


def value_of(code: Column, values: tuple[str, ...]) -> Column:
    """The value at a code, the inverse of code_of."""
    return F.element_at(F.array(*map(F.lit, values)), code + 1)
