"""Pages and feeds over a stable total order.

A cursor holds the order's values of the last row seen. The next page is what lies
beyond it, as a range predicate that reaches the scan, so a page costs no sort of what
was read before and neither repeats nor skips a row when new ones come in: those that
come after the cursor are seen later, those before it are not part of this reading.
Order columns must tell all rows apart; nulls come first.

A page of more than ``ONE_TASK`` rows is not sorted into one task: rows are numbered by
ranges, narrow, and the page is what lies between two cursors.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import ordered

#: The longest page, and the longest that one task may sort and hand over.
MOST = 10_000
ONE_TASK = 10_000


def cursor_of(row, order: list[str], kinds: dict[str, str]) -> str:
    values = [[kinds[c], None if row[c] is None else row[c].isoformat() if isinstance(row[c], (date, datetime)) else str(row[c]) if isinstance(row[c], Decimal) else row[c]] for c in order]
    return base64.urlsafe_b64encode(json.dumps([order, values]).encode()).decode()


def beyond(cursor: str, order: list[str], descending: bool = False) -> Column:
    """Rows after a cursor; ``ValueError`` if it isn't one of this order."""
    try:
        named, values = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("no cursor") from e
    if named != order:
        raise ValueError(f"a cursor of {named}, not of {order}")
    after = F.lit(False)
    for c, (kind, value) in reversed(list(zip(order, values, strict=True))):
        at = F.lit(value).cast(kind)
        if value is None:
            further = F.lit(False) if descending else F.col(c).isNotNull()
            after = further | (F.col(c).isNull() & after)
        else:
            further = (F.col(c) < at) | F.col(c).isNull() if descending else F.col(c) > at
            after = further | ((F.col(c) == at) & after)
    kind, first = values[0]
    if first is not None:  # for the scan
        bound = F.lit(first).cast(kind)
        after = after & ((F.col(order[0]) <= bound) | F.col(order[0]).isNull() if descending else F.col(order[0]) >= bound)
    return after


def _ends(rows: DataFrame, order: list[str], size: int, descending: bool) -> list[str]:
    """Cursors of every ``size``-th row and of the last: one for each page."""
    held = ordered.running_sum(rows.select(*order).withColumn("_one", F.lit(1)), [], order, "_one")
    total = held.count()
    place = total + 1 - F.col("position") if descending else F.col("position")
    found = held.where((place % size == 0) | (place == total)).select(*order, place.alias("_place")).orderBy("_place").collect()
    return [cursor_of(r, order, dict(rows.dtypes)) for r in found]


def _to(rows: DataFrame, end: str, order: list[str], descending: bool) -> DataFrame:
    return rows.where(~F.coalesce(beyond(end, order, descending), F.lit(False)))


def _checked(size: int, most: int) -> None:
    if not 1 <= size <= most:
        raise ValueError(f"size must be from 1 to {most}")


def page(rows: DataFrame, order: list[str], size: int = 100, cursor: str | None = None, descending: bool = False, most: int = MOST) -> tuple[DataFrame, str | None]:
    """The next ``size`` rows and the cursor behind them; no rows leave the cursor as it was."""
    _checked(size, most)
    if cursor is not None:
        rows = rows.where(beyond(cursor, order, descending))
    if size > ONE_TASK:
        ends = _ends(rows, order, size, descending)
        return (_to(rows, ends[0], order, descending), ends[0]) if ends else (rows.limit(0), cursor)
    sides = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in order]
    found = rows.orderBy(*sides).limit(size)
    last = found.select(*order).tail(1)
    return found, cursor_of(last[0], order, dict(rows.dtypes)) if last else cursor


def pages(rows: DataFrame, order: list[str], size: int, descending: bool = False, most: int = MOST) -> Iterator[DataFrame]:
    """Page after page to the end of what is there."""
    _checked(size, most)
    cursor = None
    if size > ONE_TASK:  # all ends at once: a page is two bounds
        for end in _ends(rows, order, size, descending):
            yield _to(rows.where(beyond(cursor, order, descending)) if cursor else rows, end, order, descending)
            cursor = end
        return
    while True:
        found, after = page(rows, order, size, cursor, descending, most)
        if after == cursor:
            return
        yield found
        cursor = after


def follow(rows: DataFrame, order: list[str], cursor: str | None, only: dict[str, str] | None = None) -> tuple[DataFrame, str | None]:
    """Everything new since a cursor, and the cursor behind it: the last row found is one row of an aggregate."""
    for column, value in (only or {}).items():
        rows = rows.where(F.col(column) == value)
    new = rows.where(beyond(cursor, order)) if cursor else rows
    last = new.agg(F.max(F.struct(*order)).alias("last")).first().last
    return new, cursor_of(last, order, dict(rows.dtypes)) if last is not None else cursor


def joined(parts: list[DataFrame]) -> DataFrame:
    """Pages with their number, from 1."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("page", F.lit(i).cast("long")) for i, p in enumerate(parts, 1)])
