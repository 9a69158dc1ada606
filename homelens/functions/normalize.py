"""Column functions that clean and classify raw fields. All are built-in expressions; bad input gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolver status codes, trimmed and upper-cased, and the bucket each belongs to.
CACHED_CODES = ("CACHE", "CACHE_STALE")
BLOCKED_CODES = (
    "GRAVITY", "REGEX", "DENYLIST", "EXTERNAL_BLOCKED_IP", "EXTERNAL_BLOCKED_NULL", "EXTERNAL_BLOCKED_NXRA",
    "EXTERNAL_BLOCKED_EDE15", "GRAVITY_CNAME", "REGEX_CNAME", "DENYLIST_CNAME", "DBBUSY", "SPECIAL_DOMAIN",
)
# Words that claim more than a lookup can show.
CLAIM_WORDS = ("viewed", "watched", "browsed", "read", "streamed", "played")


def text_or_null(x: Column) -> Column:
    """Trimmed text; blank is NULL."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def normalize_domain(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), r"\.+$", "")


def registrable_suffix(x: Column) -> Column:
    """Last two labels of a domain, or all of it if there are fewer."""
    labels = F.filter(F.split(normalize_domain(x), r"\."), lambda p: p != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(normalize_domain(x))


def normalize_mac(x: Column) -> Column:
    digits = F.regexp_replace(F.lower(x), "[^0-9a-f]", "")
    return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(?=.)", "$1:"))


def status_bucket(x: Column) -> Column:
    code = F.upper(F.coalesce(text_or_null(x), F.lit("")))
    return F.when(code.isin(*CACHED_CODES), "cached").when(code.isin(*BLOCKED_CODES), "blocked").otherwise("allowed")


def parse_time(x: Column, milliseconds: bool = False) -> Column:
    """Timestamp of a number of seconds (or milliseconds above 1e12, if allowed) or of ISO text, both as text."""
    number = x.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number) if milliseconds else number
    return F.coalesce(F.timestamp_micros(F.round(seconds * 1e6).cast("long")), F.when(number.isNull(), F.try_to_timestamp(x)))


def client_fields(payload: Column, field: Callable[[str], Column] | None = None) -> tuple[Column, Column, Column]:
    """(ip, name, identifier) of a log row whose ``client`` is an object, plain text, or absent; ``field`` gives paths taken out before."""
    get = lambda path: text_or_null(field(path) if field else F.get_json_object(payload, path))
    raw = get("$.client")
    is_object = F.coalesce(raw.startswith("{"), F.lit(False))
    ip = F.coalesce(F.when(is_object, get("$.client.ip")), F.when(~is_object, raw), get("$.client_ip"), get("$.ip"))
    name = F.coalesce(F.when(is_object, get("$.client.name")), get("$.client_name"), get("$.name"))
    return ip, name, F.coalesce(name, ip)


def window_floor(ts: Column, seconds: int) -> Column:
    """Epoch seconds of the window of ``seconds`` that holds ``ts``."""
    return F.floor(F.unix_timestamp(ts) / seconds) * seconds


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def subject_label(person: Column, device: Column, device_id: Column) -> Column:
    return F.coalesce(text_or_null(person), text_or_null(device), F.concat(F.lit("device "), device_id.cast("string")), F.lit("unattributed"))


def classify_transition(name: Column, message: Column) -> Column:
    """disconnect, connect or NULL; leaving is tested first, as its words contain those of joining."""
    text = F.lower(F.concat_ws(" ", name, message))
    return F.when(text.rlike("disconnect|disassociat"), "disconnect").when(text.rlike("connect|associat"), "connect")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to 4 places; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 4))


def overlap_seconds(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Seconds that two spans share; ends of the first may come in either order."""
    low, high = F.least(first, last), F.greatest(first, last)
    return F.greatest(F.lit(0.0), F.least(high, end).cast("timestamp").cast("double") - F.greatest(low, start).cast("timestamp").cast("double"))


def general_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, for magnitudes from 1e-4 up to 1e6."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-300)))).cast("int"))
    scale = F.pow(F.lit(10.0), digits)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(x * scale) / scale), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def claims_content(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(CLAIM_WORDS) + r")\b"), F.lit(False))


def severity_rank(x: Column) -> Column:
    return F.when(x == "high", 3).when(x == "medium", 2).when(x == "low", 1).otherwise(0)


def uplink_label(ssid: Column, network: Column, ap: Column, switch: Column, port: Column, wired: Column) -> Column:
    label = F.concat_ws(", ", F.concat(F.lit("ssid="), text_or_null(ssid)), F.concat(F.lit("network="), text_or_null(network)), F.concat(F.lit("ap="), text_or_null(ap)), F.concat(F.lit("switch="), text_or_null(switch), F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit(""))))
    return F.coalesce(F.nullif(label, F.lit("")), F.when(wired, "wired"))
