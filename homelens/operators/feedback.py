"""Feedback on findings, suppression of similar ones, and tables kept as versions.

Mutable tables are append-only: a change is a new version of a row, and views take the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.functions.normalize import normalize_domain, registrable_suffix

# Status that each classification gives a finding.
STATUS_OF = {
    "expected": "dismissed", "incorrect": "dismissed", "ignore_once": "dismissed", "suppress_similar": "dismissed",
    "concerning": "acknowledged", "needs_investigation": "acknowledged", "acknowledge": "acknowledged", "resolve": "resolved",
}


def feedback_status(classification: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[classification]


def domain_pattern(domains: Column) -> Column:
    """Of no domains ``*``, of one itself, of several with one suffix ``*.suffix``, else ``*``."""
    clean = F.array_distinct(F.filter(F.transform(domains, normalize_domain), lambda d: d != ""))
    suffixes = F.array_distinct(F.transform(clean, registrable_suffix))
    return F.when(F.size(clean) == 1, F.element_at(clean, 1)).when((F.size(clean) > 1) & (F.size(suffixes) == 1), F.concat(F.lit("*."), F.get(suffixes, F.lit(0)))).otherwise("*")


def pattern_bounds(domain: Column) -> list[Column]:
    """Aggregates of a group's domains that tell its pattern: the least and greatest domain and suffix, whatever the number of domains."""
    clean = F.nullif(normalize_domain(domain), F.lit(""))
    suffix = registrable_suffix(clean)
    return [F.min(clean).alias("least_domain"), F.max(clean).alias("last_domain"), F.min(suffix).alias("least_suffix"), F.max(suffix).alias("last_suffix")]


def bounded_pattern() -> Column:
    """``domain_pattern`` from the columns of ``pattern_bounds``."""
    one, suffix = F.col("least_domain") == F.col("last_domain"), F.col("least_suffix") == F.col("last_suffix")
    return F.when(one, F.col("least_domain")).when(suffix, F.concat(F.lit("*."), F.col("least_suffix"))).otherwise("*")


def suppression_key(rule: Column, device: Column, person: Column, pattern: Column) -> Column:
    subject = F.coalesce(F.concat(F.lit("device:"), device.cast("string")), F.concat(F.lit("person:"), person.cast("string")), F.lit("unattributed"))
    return F.concat_ws("|", rule, subject, pattern)


def suppress(drafts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drafts whose matching key is not suppressed."""
    return drafts.join(suppressions.select("matching_key").distinct(), "matching_key", "left_anti")


def latest_version(rows: DataFrame, keys: list[str], version: str = "version", deleted: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last version is deleted are gone."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
    return last.filter(~F.col(deleted)) if deleted else last


def finding_upsert(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: new findings open, known ones refreshed; closed ones are left alone and an acknowledged one
    keeps its status. ``created`` marks the new ones."""
    old = existing.select("fingerprint", F.col("status").alias("_old"))
    joined = drafts.join(old, "fingerprint", "left")
    return joined.filter(F.col("_old").isNull() | ~F.col("_old").isin("dismissed", "resolved")).withColumn("status", F.coalesce("_old", F.lit("open"))).withColumn("created", F.col("_old").isNull()).drop("_old")


def feedback_write(said: DataFrame, current: DataFrame, suppressions: DataFrame) -> DataFrame:
    """One write for ``said`` (fingerprint, classification) on current findings: rows of kind ``finding`` with the new status, of
    kind ``suppression`` for a classification that suppresses, unless its key is there, and of kind ``audit`` for each.

    Columns are those of the findings with kind, matching_key, before and after. Fingerprints without a finding are left out; of
    several classifications for one finding all must agree.
    """
    known = current.join(said.select("fingerprint", "classification").distinct(), "fingerprint")
    key = suppression_key(F.col("rule_id"), F.col("device_id"), F.lit(None), F.col("pattern"))
    judged = known.withColumn("before", F.to_json(F.struct("status"))).withColumn("status", feedback_status(F.col("classification"))).withColumn("matching_key", key)
    judged = judged.withColumn("after", F.to_json(F.struct("status", "classification"))).withColumn("created", F.lit(False))
    muting = judged.filter(F.col("classification") == "suppress_similar").join(suppressions.select("matching_key").distinct(), "matching_key", "left_anti")
    mute = muting.withColumn("after", F.to_json(F.struct("matching_key", "rule_id", F.col("pattern").alias("domain_pattern"))))
    muted = mute.groupBy("matching_key").agg(F.min_by(F.struct(*[c for c in mute.columns if c != "matching_key"]), "fingerprint").alias("_m")).select("matching_key", "_m.*")
    columns = [*current.columns, "matching_key", "before", "after"]
    of_kind = lambda frame, kind: frame.select(F.lit(kind).alias("kind"), *[c for c in columns if c != "kind"])
    audit = of_kind(judged, "audit").unionByName(of_kind(muted.withColumn("before", F.lit(None).cast("string")), "audit"))
    return of_kind(judged, "finding").unionByName(of_kind(muted, "suppression")).unionByName(audit)


def activity_upsert(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh correlation rows but for queries that a person resolved."""
    manual = existing.filter("manual").select("id").distinct()
    return fresh.join(manual, "id", "left_anti")


def with_audit(changes: DataFrame, before: list[str], after: list[str], actor: str, action: str, entity: str, id_column: str, at: str) -> DataFrame:
    """Audit rows with the changed fields before and after as JSON."""
    return changes.select(F.lit(at).cast("timestamp").alias("at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), F.col(id_column).cast("string").alias("entity_id"), F.to_json(F.struct(*before)).alias("before"), F.to_json(F.struct(*after)).alias("after"))


def assign_device(links: DataFrame, person_id: int, device_id: int, actor: str, at: str) -> DataFrame:
    """Versions to append when a device is given to a person: other links close; the same link again changes nothing."""
    now = latest_version(links, ["person_id", "device_id"]).filter(F.col("active") & (F.col("device_id") == device_id))
    stamp = F.unix_micros(F.lit(at).cast("timestamp"))
    close = now.filter(F.col("person_id") != person_id).withColumn("active", F.lit(False)).withColumn("version", stamp)
    one = links.sparkSession.range(1).select(F.lit(person_id).cast("long").alias("person_id"), F.lit(device_id).cast("long").alias("device_id"), F.lit(actor).alias("assigned_by"), F.lit(at).cast("timestamp_ntz").alias("assigned_at"), F.lit(True).alias("active"), stamp.alias("version"))
    new = one.join(now.select("person_id"), "person_id", "left_anti")
    return close.select(*new.columns).unionByName(new)
