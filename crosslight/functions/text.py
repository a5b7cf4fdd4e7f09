"""Requests, addresses, numbers and times as vendors write them, brought into one form."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time layouts that feeds use, without and with a zone.
TIME_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ssXXX",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "MMM dd yyyy HH:mm:ss",
    "dd MMM yyyy HH:mm:ss Z",
)


def parse_time(value: Column, year: int | None = None) -> Column:
    """A timestamp of any layout in use, or of an epoch in seconds, milli-, micro- or nanoseconds.

    A number's unit follows from its size. Syslog times have no year; `year` supplies it. What fits
    no layout gives null.
    """
    text = F.trim(value.cast("string"))
    number = text.try_cast("decimal(38,9)")
    size = F.abs(number)
    micros = (
        F.when(size < F.lit(10**11), number * 1_000_000)
        .when(size < F.lit(10**14), number * 1_000)
        .when(size < F.lit(10**17), number)
        .otherwise(number / 1_000)
    )
    epoch = F.timestamp_micros(F.floor(micros).try_cast("long"))
    day = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    layouts = [F.try_to_timestamp(day, F.lit(layout)) for layout in TIME_LAYOUTS]
    if year is not None:
        with_year = F.concat(F.regexp_replace(F.regexp_extract(text, r"^([A-Z][a-z]{2}\s+\d{1,2})\s", 1), r"\s+(\d)$", " 0$1"), F.lit(f" {year} "), F.regexp_extract(text, r"\s(\d{2}:\d{2}:\d{2})", 1))
        layouts.append(F.try_to_timestamp(F.regexp_replace(with_year, r"\s+", " "), F.lit("MMM dd yyyy HH:mm:ss")))
    return F.coalesce(F.when(number.isNotNull(), epoch), *layouts)


def plausible_time(time: Column) -> Column:
    """Years 2000 to 2100."""
    return F.year(time).between(2000, 2100)


def time_bucket(time: Column, micros: int) -> Column:
    """Number of the window of `micros` microseconds that a timestamp lies in."""
    return F.floor(F.unix_micros(time) / F.lit(micros)).cast("long")


def bucket_start(seconds: Column, width: int) -> Column:
    """Start of a bucket of `width` seconds, in epoch seconds."""
    return (F.floor(seconds / width) * width).cast("long")


V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


@F.pandas_udf(T.StringType())
def _canonical_v6(values: pd.Series) -> pd.Series:
    def one(value: str | None) -> str | None:
        try:
            address = ipaddress.ip_address((value or "").strip("[]"))
        except ValueError:
            return None
        mapped = getattr(address, "ipv4_mapped", None)
        return str(mapped or address)

    return values.map(one)


def plain_ip(value: Column) -> Column:
    """Address of `ip` or `ip:port` with IPv6 as it was written; null if there is none."""
    text = F.trim(value)
    v4 = F.regexp_extract(text, r"^(\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?$", 1)
    inner = F.regexp_replace(text, r"^\[([^\]]*)\](:\d+)?$", "$1")
    return F.when(v4.rlike(V4), F.regexp_replace(v4, r"\b0+(\d)", "$1")).when((v4 == "") & inner.contains(":"), inner)


def canonical_ip(ip: Column) -> Column:
    """IPv6 in its one short form; null if it is none. A vectorised function, to be applied once to a column."""
    return F.when(ip.contains(":"), _canonical_v6(ip)).otherwise(ip)


def parse_ip(value: Column) -> Column:
    """Canonical address of `ip` or `ip:port`; null if there is none."""
    return canonical_ip(plain_ip(value))


# Shared address space (private, carrier-grade, loopback, link-local), what else is not
# routable (this network and the unspecified address, benchmarks, multicast, reserved), and the ranges for examples.
SHARED = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")
BARRED = ("0.0.0.0/8", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "::/128", "ff00::/8", "2001:db8::/32")
EXAMPLES = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")


def _leading(ip: Column) -> Column:
    """The first 32 bits of an address: all of an IPv4 one, the first two groups of an IPv6 one."""
    four = [F.try_element_at(F.split(ip, r"\."), F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    two = [F.coalesce(F.conv(F.nullif(F.try_element_at(F.split(ip, ":"), F.lit(k)), F.lit("")), 16, 10).try_cast("long"), F.lit(0)) for k in (1, 2)]
    return F.when(ip.contains(":"), two[0] * 65_536 + two[1]).otherwise(((four[0] * 256 + four[1]) * 256 + four[2]) * 256 + four[3])


def within(ip: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address lies in one of some networks, which have prefixes of at most 32 bits or are single addresses."""
    nets = [ipaddress.ip_network(n) for n in networks]
    alone = [str(n.network_address) for n in nets if n.prefixlen == 128]
    spans = [(n.version == 6, int(n.network_address), int(n.broadcast_address)) for n in nets if n.prefixlen <= 32]
    tests = lambda x: [(ip.contains(":") == F.lit(v6)) & x.between(low >> 96 * v6, high >> 96 * v6) for v6, low, high in spans]
    # The number is bound by a one-element list, so that it is made once for all tests.
    found = F.exists(F.array(_leading(ip)), lambda x: reduce(lambda a, b: a | b, tests(x)))
    return F.coalesce(found, F.lit(False)) | F.coalesce(ip.isin(alone), F.lit(False))


def is_shared_ip(ip: Column) -> Column:
    """Whether many clients may stand behind a canonical address."""
    return within(ip, SHARED)


def routable_ip(ip: Column, documentation: bool = False) -> Column:
    """A global unicast address; `documentation` lets the ranges for examples pass."""
    return F.coalesce((ip.contains(":") | ip.rlike(V4)) & ~within(ip, SHARED + BARRED + (() if documentation else EXAMPLES)), F.lit(False))


def last_untrusted_hop(forwarded: Column, peer: Column, documentation: bool = False) -> Column:
    """From right to left the first routable address of a forwarded-for list that isn't the peer."""
    hops = F.transform(F.reverse(F.split(forwarded, ",")), lambda x: plain_ip(x))
    return F.try_element_at(F.array_except(F.filter(hops, lambda x: x.isNotNull() & routable_ip(x, documentation)), F.array(peer)), F.lit(1))


def split_uri(uri: Column) -> tuple[Column, Column]:
    """Path and query, cut at the first question mark."""
    at = F.locate("?", uri)
    return F.when(at > 0, F.substring_index(uri, "?", 1)).otherwise(uri), F.when(at > 0, uri.substr(at + 1, F.length(uri))).otherwise("")


def norm_path(path: Column) -> Column:
    """Lower case, single slashes, no slash at the end; the empty path is the root."""
    single = F.regexp_replace(F.lower(F.trim(path)), "/+", "/")
    bare = F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).otherwise(single)
    return F.when(bare == "", "/").otherwise(bare)


def to_status(value: Column) -> Column:
    """HTTP status from 100 to 599, else 0."""
    number = F.trim(value.cast("string")).try_cast("double").cast("int")
    return F.coalesce(F.when(number.between(100, 599), number), F.lit(0))


def as_uint32(value: Column) -> Column:
    """A number, also one like AS64500; 0 if there is none."""
    text = F.regexp_replace(F.upper(F.trim(value.cast("string"))), "^AS", "")
    number = text.try_cast("double")
    return F.coalesce(F.when(number.between(0, 4294967295), number.cast("long")), F.lit(0).cast("long"))


def as_float(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def as_list(value: Column) -> Column:
    """Parts of a list written with commas or semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def waf_score(value: Column) -> Column:
    """1 to 100, else 0 for unscored."""
    number = as_float(value).cast("int")
    return F.coalesce(F.when(number.between(1, 100), number), F.lit(0))


def header_of(raw: Column, name: str) -> Column:
    """Value of a header in a raw request, whose line ends may be escaped."""
    lines = F.regexp_replace(raw, r"\\r\\n|\\n|\r\n", "\n")
    return F.trim(F.regexp_extract(lines, rf"(?im)^{name}[ \t]*:[ \t]*(.*)$", 1))


def ray_of(raw: Column) -> Column:
    """Request id of the edge in a raw request: the part before the hyphen."""
    return F.substring_index(header_of(raw, "cf-ray"), "-", 1)


def csv_safe(value: Column) -> Column:
    """A text that a spreadsheet won't take for a formula."""
    return F.regexp_replace(value, r"^([=+\-@\t\r])", "'$1")


def framed(*parts: Column) -> Column:
    """Parts with their lengths in bytes before them, so that no two lists of parts look alike."""
    return F.concat(*(F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")), F.lit("|")) for p in parts))


def uuid_of(text: Column) -> Column:
    """A UUID of version 4 made of a text's SHA-256."""
    h = F.sha2(text, 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(h.substr(17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("4"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def event_identity(feed: Column, vendor: Column, request_id: Column, raw: Column) -> Column:
    """Digest by which redeliveries of one event are known: of its request id, or of its bytes if it has none."""
    by_id = framed(feed, F.lit("rid"), F.concat(vendor, F.lit("|"), request_id))
    return F.sha2(F.when(F.coalesce(request_id, F.lit("")) != "", by_id).otherwise(framed(feed, F.lit("raw"), raw)), 256)


def hash_chain(*fields: Column) -> Column:
    """Digest of an audit entry, which holds the digest of the one before."""
    return F.sha2(framed(*(f.cast("string") for f in fields)), 256)


def cooldown_key(rule_id: Column, group: Column) -> Column:
    """Digest of a rule and its group (a map), whatever the order of the map."""
    entries = F.transform(F.array_sort(F.map_entries(group)), lambda e: framed(e["key"], e["value"]))
    return F.sha2(F.concat(framed(rule_id), F.array_join(entries, "")), 256)


def redact(text: Column, pattern: str) -> Column:
    """What matches is masked."""
    return F.regexp_replace(text, pattern, "***")


def redact_extras(extras: Column, masked: list[Column]) -> Column:
    """Values of a map that hold any of the masked texts are masked as a whole."""
    hit = lambda v: F.coalesce(F.greatest(*(F.coalesce((m != "") & v.contains(m), F.lit(False)) for m in masked), F.lit(False)), F.lit(False))
    return F.transform_values(extras, lambda k, v: F.when(hit(v), F.lit("***")).otherwise(v))


def extra_fields(payload: Column, known: list[str]) -> tuple[Column, Column]:
    """Fields of a JSON object that the schema doesn't know: their map and their sorted names."""
    fields = F.from_json(payload, "map<string,string>")
    extra = F.map_filter(fields, lambda k, v: ~F.array_contains(F.array(*map(F.lit, known)), k))
    return extra, F.array_sort(F.map_keys(extra))


def transcript(raw: Column) -> Column:
    """Method, path, query, headers (a map) and body of a raw request."""
    lines = F.regexp_replace(raw, r"\\r\\n|\r\n|\\n", "\n")
    head = F.substring_index(lines, "\n\n", 1)
    body = F.when(F.locate("\n\n", lines) > 0, lines.substr(F.locate("\n\n", lines) + 2, F.length(lines))).otherwise("")
    first = F.substring_index(head, "\n", 1)
    uri = F.regexp_extract(first, r"^\S+\s+(\S+)", 1)
    path, query = split_uri(uri)
    rows = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9-]+\s*:"))
    pairs = F.transform(rows, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first_of = F.transform(names, lambda n: F.struct(n.alias("key"), F.filter(pairs, lambda p: p["key"] == n)[0]["value"].alias("value")))
    return F.struct(F.regexp_extract(first, r"^(\S+)", 1).alias("method"), path.alias("path"), query.alias("query"), F.map_from_entries(first_of).alias("headers"), body.alias("body"))


def captured_fields(raw: Column, host: Column, method: Column, path: Column, query: Column, user_agent: Column, client_ip: Column) -> Column:
    """What a filter expression can ask of a captured request: a map of its nine fields, its body, and whether that may be cut.

    The event's own columns come first; headers come from the transcript, and so does the user agent where the
    event has none. A transcript is the beginning of a request and doesn't say how much is missing, so every
    body counts as cut. Without an address `ip.src` is not there; all else is the empty text if unknown.
    """
    parsed = transcript(F.replace(F.coalesce(raw, F.lit("")), F.lit("%22"), F.lit('"')))
    known = lambda c: F.coalesce(c, F.lit(""))
    header = lambda n: known(F.try_element_at(parsed["headers"], F.lit(n)))
    fields = {
        "http.host": known(host),
        "http.request.method": known(method),
        "http.request.uri.path": known(path),
        "http.request.uri.query": known(query),
        "http.request.uri": F.when(known(query) == "", known(path)).otherwise(F.concat(known(path), F.lit("?"), known(query))),
        "http.user_agent": F.when(known(user_agent) == "", header("user-agent")).otherwise(user_agent),
        "http.referer": header("referer"),
        "http.cookie": header("cookie"),
        "ip.src": F.when(client_ip != "", client_ip),
    }
    found = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return F.struct(found.alias("fields"), parsed["body"].alias("body"), F.lit(True).alias("truncated"))
