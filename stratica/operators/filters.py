"""Filters over items, each a Column or a semi join, so that Catalyst can push them to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sources(column: Column, wanted: str) -> Column:
    """``a,b`` means either; ``all`` or nothing means every source."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    return F.lit(True) if not names or "all" in names else column.isin(*names)


def day_window(ts: Column, first: str | None, last: str | None) -> Column:
    """From the start of the first day through 23:59:59 of the last; a null time is in no bounded window."""
    out = F.lit(True)
    if first:
        out = out & (ts >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
    if last:
        out = out & (ts <= F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))
    return out


def members(items: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Items whose key is a member."""
    return items.join(keys.select(key), key, "left_semi")


def not_members(items: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return items.join(keys.select(key), key, "left_anti")


def has_token(column: Column, token: str, separator: str = " ") -> Column:
    """An exact token of a separated list."""
    return F.array_contains(F.split(column, separator, -1), token)


def last_match(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """Include or exclude by the last rule whose glob matches: ``*`` within a segment, ``**`` any depth, case ignored; included by default."""
    out = F.lit(True)
    for include, glob in rules:
        below = glob.endswith("/**")
        body = glob[:-3] if below else glob
        marked = "".join({"*": "[^/]*"}.get(c, c) if c.isalnum() or c in "/*_- " else "\\" + c for c in body.replace("**", "\0")).replace("\\\0", ".*")
        out = F.when(path.rlike(f"(?i)^{marked}{'(/.*)?' if below else ''}$"), F.lit(include)).otherwise(out)
    return out
