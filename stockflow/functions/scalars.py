"""Scalar column functions (SC1-SC12, PF2, PF9).

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockflow.schemas import MONEY

__all__ = [
    "ifnull", "backfill_contact_expr", "line_total", "stock_status", "is_low",
    "month_bounds", "month_start", "month_key", "in_month", "valid_gmail",
    "non_blank", "map_role", "ROLE_MAP", "compose_choice", "parse_choice",
    "format_amount", "sha256_hex", "to_long", "to_price", "signed_qty",
    "collated",
]

# UI role label -> stored role; anything else maps to 'staff'.
ROLE_MAP = {
    "Warehouse Manager": "manager",
    "Receiver": "staff",
    "Picker": "picker",
    "Admin": "admin",
    "Clerk": "staff",
    "Auditor": "staff",
    "Supervisor": "staff",
}
DEFAULT_ROLE = "staff"

# Fixed value: the Gmail address pattern the intake form enforces.
GMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@gmail\.com$"

CI_AI = "UNICODE_CI_AI"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ifnull(c, default) -> Column:
    """SC1: ``IFNULL(c, default)``."""
    return F.coalesce(_c(c), F.lit(default) if not isinstance(default, Column) else default)


def backfill_contact_expr(contact="contact", phone="phone", email="email") -> Column:
    """SC2: keep a contact; a missing one becomes phone, else email, else ''."""
    fill = F.coalesce(F.nullif(_c(phone), F.lit("")), F.nullif(_c(email), F.lit("")), F.lit(""))
    return F.when(_c(contact).isNull(), fill).otherwise(_c(contact))


def line_total(qty="quantity", price="price") -> Column:
    """PF2: ``quantity * price`` in exact decimal arithmetic."""
    return _c(qty) * _c(price)


def is_low(qty="quantity", level="reorder_level") -> Column:
    """Strict ``quantity < reorder_level``; null on either side is not low."""
    return F.coalesce(_c(qty) < _c(level), F.lit(False))


def stock_status(qty="quantity", level="reorder_level") -> Column:
    """PF9: 'LOW' when strictly below the reorder level, else 'OK' (nulls -> OK)."""
    return F.when(is_low(qty, level), F.lit("LOW")).otherwise(F.lit("OK"))


def month_bounds(month: str) -> tuple[Column, Column]:
    """SC5: 'YYYY-MM' -> [first day, first day of next month). Bad input raises
    (ANSI cast) when evaluated."""
    start = F.to_date(F.lit(f"{month}-01"), "yyyy-MM-dd")
    return start, F.add_months(start, 1)


def month_start(c) -> Column:
    """First day of the month of a date/timestamp column."""
    return F.trunc(_c(c), "month")


def month_key(c) -> Column:
    """'YYYY-MM' text of a date/timestamp column."""
    return F.date_format(_c(c), "yyyy-MM")


def in_month(c, month: str) -> Column:
    """PF5: half-open month range test that keeps the column bare (pushdown)."""
    start, end = month_bounds(month)
    return (_c(c) >= start) & (_c(c) < end)


def strip(c) -> Column:
    """Text without leading and trailing white space of any kind (tabs, line ends, ...)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def valid_gmail(c) -> Column:
    """SC6: trimmed value is a Gmail address; null -> False."""
    return F.coalesce(strip(c).rlike(GMAIL_PATTERN), F.lit(False))


def non_blank(c) -> Column:
    """SC7: not null and not only white space of any kind."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def map_role(label) -> Column:
    """SC8: UI role label -> stored role, default 'staff'."""
    pairs = []
    for k, v in ROLE_MAP.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(label)), F.lit(DEFAULT_ROLE))


def compose_choice(key, label) -> Column:
    """SC9: 'key - label' choice text."""
    return F.concat_ws(" - ", _c(key).cast("string"), _c(label))


def parse_choice(choice) -> Column:
    """SC9: the key back out of a 'key - label' text; malformed -> null."""
    return F.expr(f"try_cast(trim(split({_sql(choice)}, ' - ')[0]) AS BIGINT)")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("parse_choice takes a column name")


def format_amount(c) -> Column:
    """SC10: two-decimal text of an amount (exact decimal, no float step):
    a decimal(38,2) cast to text keeps exactly two decimals."""
    return _c(c).cast("decimal(38,2)").cast("string")


def sha256_hex(c) -> Column:
    """SC11: SHA-256 hex digest."""
    return F.sha2(_c(c).cast("string"), 256)


def to_long(c, default: int | None = None) -> Column:
    """SC12: integer conversion; unparsable -> default (or null)."""
    v = F.expr(f"try_cast({_sql(c)} AS BIGINT)") if isinstance(c, str) else _c(c).cast("long")
    return v if default is None else F.coalesce(v, F.lit(default).cast("long"))


def to_price(c) -> Column:
    """SC12: price conversion, missing -> 0.00."""
    return F.coalesce(_c(c).cast(MONEY), F.lit(0).cast(MONEY))


def signed_qty(change_type="change_type", delta="delta_qty") -> Column:
    """D-1: IN -> +|d|, OUT -> -|d|, ADJUST -> d as logged."""
    ct, d = _c(change_type), _c(delta)
    return (F.when(ct == "IN", F.abs(d)).when(ct == "OUT", -F.abs(d)).otherwise(d)).cast("long")


def collated(c) -> Column:
    """Case- and accent-insensitive comparison key for names."""
    return F.collate(_c(c), CI_AI)
