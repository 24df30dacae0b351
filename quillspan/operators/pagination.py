"""Keyset pages: a page and its continuation without OFFSET."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidCursor(ValueError):
    """The cursor is not one that this listing made."""


def clamp(limit: int | None, default: int = 50, most: int = 200) -> int:
    return default if limit is None else max(1, min(limit, most))


def encode_cursor(*parts) -> str:
    text = "|".join("" if p is None else p.isoformat() if isinstance(p, datetime) else str(p) for p in parts)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def _parts(cursor: str, n: int) -> list[str]:
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except (ValueError, binascii.Error) as e:
        raise InvalidCursor(cursor) from e
    first, _, rest = text.partition("|")
    parts = [first, rest] if n == 2 else [first, *rest.rsplit("|", n - 2)]
    if len(parts) != n or "|" not in text:
        raise InvalidCursor(cursor)
    return parts


def decode_time_cursor(cursor: str) -> tuple[datetime, int]:
    at, id_ = _parts(cursor, 2)
    try:
        return datetime.fromisoformat(at), int(id_)
    except ValueError as e:
        raise InvalidCursor(cursor) from e


def decode_sort_cursor(cursor: str, sort: str) -> tuple[str | None, int]:
    """(key, id) of a cursor made for ``sort``; the key is None in the tail of missing values."""
    made_for, key, id_ = _parts(cursor, 3)
    if made_for != sort:
        raise InvalidCursor(cursor)
    try:
        return key or None, int(id_)
    except ValueError as e:
        raise InvalidCursor(cursor) from e


def newest_first(df: DataFrame, limit: int, after: tuple[datetime, int] | None = None, time: str = "created_at", id_col: str = "id") -> DataFrame:
    """``limit + 1`` rows by (time, id) descending after the cursor; the extra row tells whether there is more."""
    if after:
        at = F.lit(after[0]).cast(df.schema[time].dataType)
        df = df.where(F.struct(time, id_col) < F.struct(at.alias(time), F.lit(after[1]).cast(df.schema[id_col].dataType).alias(id_col)))
    return df.orderBy(F.col(time).desc(), F.col(id_col).desc()).limit(limit + 1)


@dataclass(frozen=True)
class Sort:
    """A sort key with an id tie-break; a nullable descending key has its missing values last."""

    column: str
    descending: bool = False

    def order(self, id_col: str = "id") -> list[Column]:
        if self.descending:
            return [F.col(self.column).desc_nulls_last(), F.col(id_col).desc()]
        return [F.col(self.column).asc_nulls_last(), F.col(id_col).asc()]

    def after(self, key, id_: int, id_col: str = "id") -> Column:
        """Rows that follow (key, id), including the tail of missing values."""
        c, i = F.col(self.column), F.col(id_col)
        if key is None:
            return c.isNull() & ((i < id_) if self.descending else (i > id_))
        k = F.lit(key)
        further = (c < k) if self.descending else (c > k)
        tie = (c == k) & ((i < id_) if self.descending else (i > id_))
        return further | tie | c.isNull()


def sorted_page(df: DataFrame, sort: Sort, limit: int, after: tuple | None = None, id_col: str = "id") -> DataFrame:
    if after:
        df = df.where(sort.after(after[0], after[1], id_col))
    return df.orderBy(*sort.order(id_col)).limit(limit + 1)


def contains_text(column: str, query: str | None) -> Column:
    """Case-insensitive substring test in which the query has no wildcards; a blank query filters nothing."""
    if query is None or not query.strip():
        return F.lit(True)
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(query.strip())))
