"""Column functions that turn raw log text and raw clocks into the common schema."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry import catalog


def severity_norm(raw: Column) -> Column:
    """The common severity of a raw code; absent and unmapped codes are `unknown`. A CASE stays in codegen, a map lookup doesn't."""
    out = F.when(F.lit(False), F.lit(""))
    for level in dict.fromkeys(catalog.SEVERITIES.values()):
        out = out.when(raw.isin([k for k, v in catalog.SEVERITIES.items() if v == level]), F.lit(level))
    return out.otherwise(F.lit(catalog.UNKNOWN_SEVERITY))


def route(source: Column, raw: Column, message: Column) -> Column:
    """The tier of a text record, by its raw severity: DDS without a severity, and stdout without a message, go nowhere."""
    dds = F.when(raw == "inf", "local").when(raw.isNotNull(), "central")
    stdout = F.when(raw == "Info", "local").when(message.isNotNull(), "central")
    return F.when(source == "dds", dds).when(source == "stdout", stdout).otherwise(source)


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def dds_fields(line: Column) -> Column:
    """time, severity, source, tid and message of a DDS record; a line that isn't one keeps only its message."""
    ok = line.rlike(catalog.DDS_LINE)
    parts = [F.when(ok, _group(line, catalog.DDS_LINE, k + 1)).alias(n) for k, n in enumerate(("time", "severity", "source", "tid"))]
    return F.struct(*parts, F.when(ok, F.regexp_extract(line, catalog.DDS_LINE, 5)).otherwise(line).alias("message"))


def stdout_fields(line: Column) -> Column:
    """time, severity, facility and message of an output line; all but the message are optional."""
    parts = [_group(line, catalog.STDOUT_LINE, k + 1).alias(n) for k, n in enumerate(("time", "severity", "facility"))]
    return F.struct(*parts, F.regexp_extract(line, catalog.STDOUT_LINE, 4).alias("message"))


def path_fields(path: Column) -> Column:
    """source_file (the last part of a path) and host (null if the file isn't named after one)."""
    return F.struct(F.regexp_extract(path, catalog.PATH, 1).alias("source_file"), _group(path, catalog.PATH, 2).alias("host"))


def name_time(path: Column) -> Column:
    """The time in a file's name in epoch ms, or null."""
    part = [F.try_to_number(F.nullif(F.regexp_extract(path, catalog.NAME_TIME, k), F.lit("")), F.lit("9999")).cast("int") for k in range(1, 7)]
    return F.unix_millis(F.try_make_timestamp(*part[:5], part[5].cast("decimal(8,6)")))


def line_time(base_ms: Column, line_number: Column) -> Column:
    """An output line's time as text: the file's second and the line's number, modulo a million, as microseconds."""
    return F.concat(F.date_format(F.timestamp_millis(base_ms), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad((line_number % 1_000_000).cast("string"), 6, "0"))


def epoch_ms(value: Column) -> Column:
    """Epoch milliseconds of a clock held as a number or written as seconds, milliseconds or ISO text; -1 if it can't be read.

    Numbers below 1e11 are seconds, a fraction of which is dropped; text without a zone is UTC. A double is written with an
    exponent from ten million on, so of numbers that form is read as well; of text, what stands before a dot counts.
    """
    s = F.trim(value.cast("string"))
    digits = s.rlike(r"^\d[^-T ]*$")
    plain = F.try_to_number(F.regexp_extract(s, r"^(\d{1,18})(?:\..*)?$", 1), F.lit("9" * 18)).cast("long")
    whole = F.when((F.typeof(value) != "string") & s.rlike(r"^\d(?:\.\d+)?E\d{1,2}$"), s.try_cast("decimal(38,9)").try_cast("long")).otherwise(plain)
    number = F.when(whole < 100_000_000_000, whole * 1000).otherwise(whole)
    text = F.unix_millis(F.try_to_timestamp(F.replace(s, F.lit(" "), F.lit("T"))))
    return F.when(digits, F.coalesce(number, F.lit(-1).cast("long"))).otherwise(F.coalesce(text, F.lit(-1).cast("long")))


def lag_ms(later: Column, earlier: Column) -> Column:
    """later - earlier where both clocks could be read; may be negative."""
    return F.when((later >= 0) & (earlier >= 0), later - earlier)


def percent(text: Column) -> Column:
    """`87%` as 87.0; null if it isn't a number."""
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double")


def status_code(status: Column) -> Column:
    return F.when(status == "green", 0).when(status == "yellow", 1).when(status == "red", 2).otherwise(3)


def disk_percent(total: Column, available: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(100.0 * (total - available) / total, 1))


def label_list(labels: Column) -> Column:
    """A map as a sorted list of key=value."""
    return F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def id_list(text: Column, most: int = 500) -> Column:
    """Comma-separated ids as a list without blanks and repeats, in order, at most `most`."""
    trimmed = F.transform(F.split(text, ","), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: x != "")), 1, most)


def content_hash(**fields: Column) -> Column:
    """32 hex digits of the SHA-256 of the fields as compact JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256), 1, 32)


def source_uid(table: Column, row_id: Column) -> Column:
    return F.sha1(F.concat(F.length(table).cast("string"), F.lit(":"), table, F.lit(":"), row_id).cast("binary"))


def scope_label(scope: Column, collector: Column) -> Column:
    return F.when(scope == "fleet", F.lit("fleet")).otherwise(F.concat(F.lit("collector:"), F.coalesce(F.nullif(collector, F.lit("")), F.lit(catalog.NONE))))


def iso_seconds(ms: Column) -> Column:
    """ISO text of epoch ms, cut to whole seconds and written with .000."""
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^a-z0-9_]+")


def any_token(text: Column, *terms: str) -> Column:
    """Full-text match: any of the terms is a token of the text, in any case; false for null. One pass, and no list of tokens."""
    found = "|".join(re.escape(t.lower()) for t in terms)
    return F.coalesce(F.lower(text).rlike(f"(?<![a-z0-9_])(?:{found})(?![a-z0-9_])"), F.lit(False))


def origin_host(hostname: Column, host: Column) -> Column:
    """The host a record comes from: its own field first, the collector's second; null if neither has one."""
    return F.coalesce(F.nullif(hostname, F.lit("")), F.nullif(host, F.lit("")))


def live_message(message: Column, log: Column) -> Column:
    """What the live lane shows: the message, or the raw line, or nothing."""
    return F.coalesce(message, log, F.lit(""))


def nice_max(top: Column) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that reaches `top`: an axis's end; 1 for what isn't positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(top)))
    steps = F.lit(10.0) * power
    for step in (5.0, 2.5, 2.0, 1.0):
        steps = F.when(top <= F.lit(step) * power * (1 + 1e-12), F.lit(step) * power).otherwise(steps)
    return F.when(top > 0, steps).otherwise(F.lit(1.0))


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(data.cast("string"))


def host_shard(host: Column, n: int) -> Column:
    """The digits of a host's name as a number, modulo n; null without digits."""
    return F.pmod(F.try_to_number(F.nullif(F.regexp_replace(host, r"\D", ""), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(n))


def render(template: Column, **values: Column) -> Column:
    """A template with {name} places filled from columns."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return template


def rate_at(second: Column, profile: str, low: float, high: float, period: float = 150.0, burst: float = 30.0, length: float = 600.0) -> Column:
    """Offered records a second at a moment of a load profile: steady, ramp or burst."""
    if profile == "steady":
        return F.lit(float(high))
    if profile == "ramp":
        return F.lit(float(low)) + (F.lit(float(high - low)) * F.least(F.lit(1.0), second / F.lit(float(length))))
    return F.when(F.pmod(second, F.lit(float(period))) < F.lit(float(burst)), F.lit(float(high))).otherwise(F.lit(float(low)))
