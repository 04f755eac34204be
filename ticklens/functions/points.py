"""Price points: one price of a frame and the time it was quoted.

Each kind is a minimum or maximum over (time, price) or (price, time), so it does
not depend on the order in which quotes arrive, and two partial results merge
into one:

======  ======================  =============================
kind    quote it names          if several qualify
======  ======================  =============================
open    the earliest            lowest price of that instant
close   the latest              highest price of that instant
high    the highest             latest of that price
low     the lowest              earliest of that price
======  ======================  =============================

A quote without a price or without a time names no point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("open", "close", "high", "low")


@dataclass(frozen=True)
class PricePoint:
    """A point to report, and the names of its two output columns."""

    kind: str
    price: str
    price_name: str
    ts_name: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

    @property
    def partial(self) -> str:
        """Column of the partial result this point is read from."""
        return f"{self.kind}_{self.price}"


def point(kind: str, price: str = "ask") -> PricePoint:
    return PricePoint(kind, price, f"{kind}_price", f"{kind}_price_ts")


def open_close(price: str = "ask") -> list[PricePoint]:
    return [point("open", price), point("close", price)]


def high_low(price: str = "ask") -> list[PricePoint]:
    return [point("high", price), point("low", price)]


def max_and_close(prices: tuple[str, ...] = ("ask", "bid")) -> list[PricePoint]:
    """Maximum and close of each price, under the names of the price summary."""
    return [
        PricePoint(kind, price, f"{name}_{price}", f"{name}_{price}_dt")
        for price in prices
        for name, kind in (("max", "high"), ("close", "close"))
    ]


def aggregate_point(spec: PricePoint, where: str, ts: str = "ts") -> list[Column]:
    """Aggregates over the rows that meet `where`: the price and the time of a point.

    The rows of a group must share one day. Ordering by one number that holds time
    and price keeps the buffers fixed-width, hence a hash aggregation; ordering by
    a struct would sort every joined quote first. A price has at most six digits
    and a second of the day five before the point, so the factors keep the two
    parts of the number apart. No time zone takes part.
    """
    price = f"CAST({spec.price} AS DECIMAL(12,6))"
    usable = f"{where} AND {price} IS NOT NULL"
    second = f"(hour({ts}) * 3600 + minute({ts}) * 60 + extract(SECOND FROM {ts}))"
    time_first = f"CASE WHEN {usable} THEN {second} * 10000000000000 + {price} END"
    price_first = f"CASE WHEN {usable} THEN {price} * 1000000000000 + {second} END"
    aggregates = {
        "open": (f"min_by({price}, {time_first})", f"min(CASE WHEN {usable} THEN {ts} END)"),
        "close": (f"max_by({price}, {time_first})", f"max(CASE WHEN {usable} THEN {ts} END)"),
        "high": (f"max(CASE WHEN {usable} THEN {price} END)", f"max_by({ts}, {price_first})"),
        "low": (f"min(CASE WHEN {usable} THEN {price} END)", f"min_by({ts}, {price_first})"),
    }
    price_agg, ts_agg = aggregates[spec.kind]
    return [
        F.expr(f"{price_agg} AS {spec.partial}"),
        F.expr(f"{ts_agg} AS {spec.partial}_ts"),
    ]


def merge_point(spec: PricePoint, where: str, alias: str) -> Column:
    """Merge partial results of `aggregate_point` that meet `where` into one struct."""
    price, ts = f"{spec.partial} AS price", f"{spec.partial}_ts AS ts"
    order = f"{ts}, {price}" if spec.kind in ("open", "close") else f"{price}, {ts}"
    best = "min" if spec.kind in ("open", "low") else "max"
    usable = f"{where} AND {spec.partial} IS NOT NULL"
    return F.expr(f"{best}(CASE WHEN {usable} THEN struct({order}) END) AS {alias}")
