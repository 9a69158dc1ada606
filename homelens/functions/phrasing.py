"""Sentences about lookups that claim no more than a lookup shows, and checks of user-given values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.functions.normalize import claims_content, text_or_null

UNITS = {"h": 3600, "d": 86400}


def dns_lookup(domain: Column, subject: Column, blocked: Column) -> Column:
    """One lookup; the subject is left out where there is none."""
    who = F.when(subject.isNotNull() & (subject != "") & (subject != "unattributed"), F.concat(F.lit(" attributed to "), subject)).otherwise("")
    return F.concat(F.when(blocked, "Blocked DNS lookup for ").otherwise("DNS lookup for "), F.coalesce(text_or_null(domain), F.lit("an unknown domain")), who)


def dns_volume(count: Column, subject: Column) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, " DNS lookup").otherwise(" DNS lookups"), F.lit(" attributed to "), subject)


def blocked_burst(count: Column, minutes: Column, subject: Column) -> Column:
    return F.concat(count.cast("string"), F.lit(" blocked DNS lookups attributed to "), subject, F.lit(" within "), minutes.cast("string"), F.lit(" minutes"))


def honest(drafts: DataFrame, *texts: str) -> DataFrame:
    """``drafts``; a text that claims content was seen fails the job, naming it."""
    told = F.coalesce(*[F.when(claims_content(F.col(t)), F.col(t)) for t in texts])
    return drafts.filter(F.when(told.isNotNull(), F.raise_error(F.concat(F.lit("text claims that content was seen: "), told))).otherwise(F.lit(True)))


def window_seconds(window: str) -> int:
    """Seconds of ``Nh`` or ``Nd``; anything else raises ValueError."""
    found = re.fullmatch(r"([0-9]+)([hd])", window.strip().lower())
    if not found or int(found[1]) < 1:
        raise ValueError(f"not a window such as 24h or 7d: {window!r}")
    return int(found[1]) * UNITS[found[2]]
