"""Search filters, ranges, paging and export."""

from __future__ import annotations

import base64
import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_safe

# The longest range in days, page sizes, entries of a panel, rows of an export.
MAX_RANGE_DAYS, PAGE, MAX_PAGE, PANEL, MAX_PANEL, EXPORT = 90, 100, 1000, 10, 100, 100_000
DAY = 86_400


def has_token(column: Column, token: str) -> Column:
    """Whether an alphanumeric token stands in a text as a whole; case counts."""
    return F.exists(F.split(column, "[^0-9A-Za-z]+"), lambda t: t == token)


def is_in(column: Column, values: list) -> Column:
    if not values:
        raise ValueError("a list of values must not be empty")
    return column.isin(values)


def has_any(column: Column, values: list) -> Column:
    if not values:
        raise ValueError("a list of values must not be empty")
    return F.arrays_overlap(column, F.array(*map(F.lit, values)))


def map_value(column: Column, key: str) -> Column:
    """The value of a key, the empty text if there is none."""
    return F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(""))


OPERATIONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "in": is_in,
    "contains": lambda c, v: c.contains(v),
    "token": has_token,
    "overlaps": has_any,
    "has": lambda c, v: F.array_contains(c, v),
    "case_fold": lambda c, v: F.lower(c) == v.lower(),
}

#: Name of a filter, its operation and column.
EVENT_FILTERS = {
    "client_ip": ("eq", "client_ip"),
    "host": ("eq", "request_host"),
    "path": ("eq", "request_path"),
    "rule": ("eq", "rule_id"),
    "country": ("eq", "client_country"),
    "method": ("eq", "request_method"),
    "request_id": ("eq", "vendor_request_id"),
    "linked_request_id": ("eq", "linked_request_id"),
    "vendors": ("in", "vendor"),
    "verdicts": ("in", "verdict"),
    "score_min": ("ge", "score"),
    "score_max": ("le", "score"),
    "asn": ("eq", "client_asn"),
    "status": ("eq", "http_status"),
    "ja4": ("eq", "ja4"),
    "waf_score_min": ("ge", "waf_attack_score"),
    "waf_score_max": ("le", "waf_attack_score"),
    "waf_action": ("eq", "waf_action"),
    "waf_source": ("eq", "waf_source"),
    "user_agent": ("token", "user_agent"),
    "q": ("token", "request_path"),
    "path_contains": ("contains", "request_path"),
}
RECORD_FILTERS = {
    "event_ids": ("overlaps", "event_ids"),
    "client_ip": ("eq", "client_ip"),
    "host": ("eq", "request_host"),
    "path": ("eq", "request_path"),
    "country": ("eq", "client_country"),
    "asn": ("eq", "client_asn"),
    "min_vendors": ("ge", "vendor_count"),
    "kind": ("eq", "disagreement_kind"),
    "confidence": ("eq", "confidence"),
    "outcome": ("eq", "combined_outcome"),
    "matched_rule": ("has", "matched_rules"),
}


def passes(spec: dict, known: dict[str, tuple[str, str]]) -> Column:
    """Whether a row passes all filters of a specification; an unknown name is an error."""
    spec = dict(spec)
    tests = []
    if spec.pop("only_disagreements", False):
        tests.append(F.col("has_disagreement"))
    for name, value in spec.items():
        if name not in known:
            raise ValueError(f"unknown filter {name}")
        operation, column = known[name]
        tests.append(OPERATIONS[operation](F.col(column), value))
    if "waf_score_max" in spec:
        tests.append(F.col("waf_attack_score") >= 1)  # 0 is unscored, not low
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filtered(rows: DataFrame, spec: dict, known: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that pass all filters of a specification; an unknown name fails all of it."""
    return rows.where(passes(spec, known))


def search_events(rows: DataFrame, spec: dict) -> DataFrame:
    return filtered(rows, spec, EVENT_FILTERS)


def search_records(rows: DataFrame, spec: dict) -> DataFrame:
    return filtered(rows, spec, RECORD_FILTERS)


def time_range(rows: DataFrame, start: int, end: int, now: int, column: str = "event_time", closed: bool = False) -> DataFrame:
    """Rows from `start` up to `end` (epoch seconds), which can't lie after `now`; at most MAX_RANGE_DAYS."""
    end = min(end, now)
    if start >= end:
        raise ValueError("a range must start before it ends")
    if end - start > MAX_RANGE_DAYS * DAY:
        raise ValueError(f"a range spans {MAX_RANGE_DAYS} days at most")
    at = F.col(column)
    return rows.where((at >= start) & ((at <= end) if closed else (at < end)))


def near_partition(rows: DataFrame, start: int, end: int, lateness: int = 900, column: str = "window_start") -> DataFrame:
    """Rows of the day partitions that may hold versions of records between two times."""
    return rows.where(F.col(column).between(start - DAY - lateness, end + DAY + lateness))


def drop_rules(rows: DataFrame, rules: list[tuple[str, str, str]], limit: int = 64) -> DataFrame:
    """Rows that no drop rule (field, kind, value) matches; case doesn't count and blank fields never match."""
    if len(rules) > limit:
        raise ValueError(f"{limit} drop rules at most")
    columns = {"host": "request_host", "path": "request_path"}
    kinds = {"equals": lambda c, v: c == v, "suffix": lambda c, v: c.endswith(v), "prefix": lambda c, v: c.startswith(v), "contains": lambda c, v: c.contains(v)}
    tests = []
    for field, kind, value in rules:
        own = F.lower(F.trim(F.coalesce(columns[field], F.lit(""))))
        tests.append((own != "") & kinds[kind](own, value.lower()))
    return rows.where(~reduce(lambda a, b: a | b, tests)) if tests else rows


def age_gate(rows: DataFrame, days: int = 90, ahead: int = 300) -> DataFrame:
    """With `reason`: TIMESTAMP_OUT_OF_RANGE for events too old or too far ahead of their receipt, else null."""
    good = F.col("event_time").between(F.col("received_at") - days * DAY, F.col("received_at") + ahead)
    return rows.withColumn("reason", F.when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise("TIMESTAMP_OUT_OF_RANGE"))


def page_size(asked: int) -> int:
    return PAGE if asked <= 0 else min(asked, MAX_PAGE)


def panel_size(asked: int) -> int:
    return asked if 0 < asked <= MAX_PANEL else PANEL


@dataclass(frozen=True)
class Cursor:
    """Place after which a page begins: the sort value and the id of the last row."""

    at: int
    key: str

    def encode(self) -> str:
        return base64.urlsafe_b64encode(b"\x01" + struct.pack(">q", self.at) + self.key.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        if len(text) > 512:
            raise ValueError("the cursor is too long")
        try:
            data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
            if len(data) < 10 or data[0] != 1:
                raise ValueError
            return cls(struct.unpack(">q", data[1:9])[0], data[9:].decode())
        except (ValueError, struct.error, UnicodeDecodeError) as fault:
            raise ValueError("the cursor can't be read") from fault


def page(rows: DataFrame, sort: str = "event_time", key: str = "event_id", size: int = PAGE, after: Cursor | None = None) -> DataFrame:
    """A page in descending order and one row more, which tells whether another page follows.

    The rows must hold one version of each key.
    """
    if after:
        rows = rows.where((F.col(sort) < after.at) | ((F.col(sort) == after.at) & (F.col(key) < after.key)))
    return rows.orderBy(F.desc(sort), F.desc(key)).limit(page_size(size) + 1)


def page_total(rows_on_page: int, size: int, first_page: bool) -> tuple[int, bool]:
    """Number of results and whether it is exact: only if all of them fit on the first page."""
    return min(rows_on_page, size), first_page and rows_on_page <= size


def export(rows: DataFrame, limit: int = EXPORT, sort: str = "event_time", key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The newest rows to write, by time and id, and a one-row frame that tells whether there were more."""
    newest = rows.orderBy(F.desc(sort), F.desc(key))
    return newest.limit(limit), newest.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV whose texts can't act as formulas; lists and maps are written as JSON."""
    columns = []
    for field in rows.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            columns.append(csv_safe(F.to_json(field.name)).alias(field.name))
        else:
            columns.append(csv_safe(F.col(field.name)).alias(field.name) if kind == "string" else F.col(field.name))
    rows.select(*columns).write.option("header", True).csv(path)
