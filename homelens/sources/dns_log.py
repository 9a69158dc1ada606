"""DNS resolver query logs: envelopes of JSON rows, normalized to typed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from homelens.functions.normalize import client_fields, parse_time, status_bucket, text_or_null
from homelens.session import shared_folder

LOGIC_VERSION = "dns_query.v1"
FIELDS = ("time", "timestamp", "client", "client.ip", "client.name", "client_ip", "ip", "client_name", "name", "domain", "type", "status", "upstream", "id", "legacy_row")


def envelope_rows(texts: DataFrame, keys: tuple[str, ...] = ("queries", "data")) -> DataFrame:
    """(payload) one JSON text a row from envelopes (value): a bare list, or an object with a list under one of ``keys``.

    A row that is itself a list becomes ``{"legacy_row": [...]}``, which normalization rejects.
    """
    lists = [F.get_json_object("value", f"$.{k}") for k in keys]
    body = F.when(F.trim("value").startswith("["), F.trim("value")).otherwise(F.coalesce(*lists))
    rows = F.explode(F.transform(F.expr("CAST(try_parse_json(body) AS array<variant>)"), lambda v: F.to_json(v)))
    each = texts.select(body.alias("body")).filter("body IS NOT NULL").select(rows.alias("payload"))
    return each.withColumn("payload", F.when(F.col("payload").startswith("["), F.concat(F.lit('{"legacy_row":'), "payload", F.lit("}"))).otherwise(F.col("payload")))


def read_envelopes(spark: SparkSession, path: str, keys: tuple[str, ...] = ("queries", "data")) -> DataFrame:
    """Rows of the JSON files at ``path``, one envelope a file."""
    return envelope_rows(spark.read.text(path, wholetext=True), keys)


def normalize_queries(payloads: DataFrame) -> DataFrame:
    """Typed lookups of (payload), with ``error`` where time, domain or client is missing.

    The fields are taken out of the JSON by a generator of one row, so each is parsed once and not again wherever it is used.
    """
    get = lambda k: F.col(f"`$.{k}`")
    ip, _, identifier = client_fields(F.col("payload"), lambda path: F.col(f"`{path}`"))
    taken = F.inline(F.array(F.struct(*[F.get_json_object("payload", f"$.{k}").alias(f"$.{k}") for k in FIELDS])))
    out = payloads.select("payload", taken).select(
        F.lit(LOGIC_VERSION).alias("logic_version"), parse_time(F.coalesce(get("time"), get("timestamp"))).alias("queried_at"), identifier.alias("client_identifier"), ip.alias("client_ip"), text_or_null(get("domain")).alias("domain"),
        F.coalesce(text_or_null(get("type")), F.lit("UNKNOWN")).alias("query_type"), status_bucket(get("status")).alias("status"), text_or_null(get("upstream")).alias("upstream"), get("id").alias("source_id"), get("legacy_row").isNotNull().alias("legacy"), "payload",
    )
    error = F.when(F.col("legacy"), "legacy row").when(F.col("queried_at").isNull(), "no time").when(F.col("domain").isNull(), "no domain").when(F.col("client_identifier").isNull(), "no client")
    return out.withColumn("error", error).drop("legacy")


def append_batch(rows: DataFrame, path: str, on_error: str = "fail", once: bool = True) -> int:
    """Append normalized rows by day. One bad row fails the batch, or goes to ``<path>_rejected`` with ``quarantine``.

    With ``once``, rows that repeat a source id within the batch are written once. Returns the rows written.
    """
    shared_folder(rows.sparkSession, "batch")  # sets the checkpoint folder where none is set
    rows = rows.checkpoint()
    counts = rows.agg(F.count("error").alias("bad"), F.min("error").alias("why")).first()
    if on_error == "fail" and counts["bad"]:
        raise ValueError(f"batch rejected: {counts['why']}")
    if on_error == "quarantine" and counts["bad"]:
        rows.filter("error IS NOT NULL").write.mode("append").parquet(f"{path}_rejected")
    good = rows.filter("error IS NULL").drop("error")
    if once:
        good = good.filter("source_id IS NULL").unionByName(good.filter("source_id IS NOT NULL").dropDuplicates(["source_id"]))
    seen = Observation("appended")
    good.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("day", F.to_date("queried_at")).write.mode("append").partitionBy("day").parquet(path)
    return seen.get["n"]
