"""Syslog lines: envelope, then CEF, firewall or event body, by built-in regular-expression functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.functions.normalize import normalize_mac, text_or_null

LOGIC_VERSION = "controller_syslog.v1"
# Line formats of the controller.
ENVELOPE = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+)?(.*)$"
CEF = r"(?s)CEF:(\d+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|([^|]+)\|(.*)$"
PAIR = r"(?s)([A-Za-z0-9._]+)=((?:\\.|[^=])*?)(?=\s+[A-Za-z0-9._]+=|$)"
ESCAPED = r"(?s)\\.|[^\\]+|\\$"
MAC_KEYS = ("unificlientmac", "mac", "srcmac", "dstmac", "unifilastconnectedtodevicemac")
ZONES = "SRC=|DST=|LAN_LOCAL|WAN_LOCAL|WAN_IN|LAN_IN"
RULE_NAME, DESCR = r"\[([A-Za-z0-9_-]+)\]", r'(?i)DESCR="([^"]*)"'
SRC, DST, PROTO = r"(?i)\bSRC=(\S+)", r"(?i)\bDST=(\S+)", r"(?i)\bPROTO=(\S+)"
USER, AP = r"(?i)User\[([0-9A-Fa-f:.-]{11,17})\]", r"(?i)\bAP\[([0-9A-Fa-f:.-]{11,17})\]"
EVENT_KEY, SSID = r"\b(EVT_[A-Za-z0-9_]+)\b", r"(?i)(?:SSID|essid)\[([^\]]+)\]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files at ``path`` but blank ones and comments."""
    return spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')")


def _find(body: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))


def _mac(x: Column) -> Column:
    return F.coalesce(normalize_mac(x), F.lower(text_or_null(x)))


def _unescape(x: Column) -> Column:
    """CEF escapes undone in one pass from left to right: the character after a backslash stands for itself, but n and r for line ends."""
    parts = F.regexp_extract_all(x, F.lit(ESCAPED), F.lit(0))
    plain = lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p.startswith("\\") & (F.length(p) == 2), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, plain), "")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with format, event_name, category, sub_category, mac, client_ip, dst_ip, proto, ssid, ap_mac,
    hostname, msg, severity and pri; lines of no known format stay, with format NULL."""
    raw = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    body = F.regexp_extract(raw, ENVELOPE, 3)
    split = lines.withColumn("_b", body).withColumn("pri", _find(raw, ENVELOPE, 1).try_cast("int"))
    b = F.col("_b")
    ext = F.trim(F.regexp_extract("_b", CEF, 8))
    split = split.withColumn("_k", F.regexp_extract_all(ext, F.lit(PAIR), 1)).withColumn("_v", F.regexp_extract_all(ext, F.lit(PAIR), 2))
    split = split.withColumn("_m", F.map_from_arrays(F.array_distinct("_k"), F.transform(F.array_distinct("_k"), lambda k: F.element_at(F.filter(F.zip_with("_k", "_v", lambda a, v: F.struct(a.alias("k"), v.alias("v"))), lambda p: p["k"] == k), -1)["v"])))
    get = lambda *keys: F.coalesce(*[F.nullif(_unescape(F.trim(F.element_at("_m", F.lit(k)))), F.lit("")) for k in keys])
    is_mac = lambda k: F.lower(k).endswith("mac") | F.replace(F.lower(k), F.lit("_"), F.lit("")).isin(*MAC_KEYS)
    macs = F.filter(F.transform(F.filter("_k", is_mac), lambda k: F.trim(F.element_at("_m", k))), lambda v: v != "")
    upper, lower = F.upper(b), F.lower(b)
    cef = b.rlike(CEF)
    firewall = ~cef & b.rlike(RULE_NAME) & upper.rlike(ZONES)
    user, key = _find(b, USER), _find(b, EVENT_KEY)
    event = ~cef & ~firewall & (user.isNotNull() | key.isNotNull())
    ssid = F.trim(_find(b, SSID))
    wifi = ssid.isNotNull() | lower.contains("ssid")
    leaves = lower.contains("disconnect")
    joins = lower.rlike("connect|associat")
    threat = lower.rlike("blocked|threat|firewall")
    pick = lambda c, f, e: F.when(cef, c).when(firewall, f).when(event, e)
    null = F.lit(None).cast("string")
    return split.select(
        *lines.columns, "pri", F.when(cef | firewall | event, F.lit(LOGIC_VERSION)).alias("logic_version"), pick(F.lit("cef"), F.lit("firewall"), F.lit("event")).alias("format"),
        pick(F.regexp_extract("_b", CEF, 6), _find(b, RULE_NAME), F.coalesce(key, F.lit("event"))).alias("event_name"),
        pick(get("UNIFIcategory", "category"), F.lit("Security"), F.when(leaves | joins, "Monitoring").when(threat, "Security").otherwise("System")).alias("category"),
        pick(get("UNIFIsubCategory", "subCategory"), F.lit("Firewall"), F.when(leaves, F.when(wifi | lower.contains("wifi"), "WiFi").otherwise("Wired")).when(joins, F.when(wifi, "WiFi").otherwise("Wired")).when(threat, "Threat").otherwise("Event")).alias("sub_category"),
        pick(_mac(F.get(macs, F.lit(0))), null, _mac(user)).alias("mac"), pick(get("UNIFIclientIp", "src", "dst"), _find(b, SRC), null).alias("client_ip"), pick(null, _find(b, DST), null).alias("dst_ip"), pick(null, _find(b, PROTO), null).alias("proto"),
        pick(get("UNIFIwifiName", "UNIFIssid", "ssid"), null, ssid).alias("ssid"), pick(null, null, _mac(_find(b, AP))).alias("ap_mac"), pick(get("UNIFIclientHostname", "UNIFIclientName"), null, null).alias("hostname"),
        pick(get("msg"), F.trim(F.coalesce(_find(b, DESCR), b)), F.trim(b)).alias("msg"), pick(F.regexp_extract("_b", CEF, 7), null, null).alias("severity"), pick(F.regexp_extract("_b", CEF, 2), null, null).alias("vendor"), F.when(cef, F.col("_m")).alias("extensions"),
    )


def parse_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("lines"), F.count("format").alias("parsed"), F.count_if(F.col("format").isNull()).alias("unparsed"))
