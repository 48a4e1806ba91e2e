"""Scalar expressions; each takes and returns columns, and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(path: Column) -> Column:
    """The immediate parent directory: '.' for a file at the root or no path, '' directly under '/'."""
    return F.when(path.isNull() | (F.instr(path, "/") == 0), ".").otherwise(F.regexp_replace(path, r"(?s)/[^/]*\z", ""))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def presence(text: Column) -> Column:
    """NULL where blank; otherwise the text as it is."""
    return F.when(text.rlike(r"\S"), text)


def signal(entity: Column, action: Column, behavior: Column, name: Column) -> Column:
    """struct(text, source): the intent's three parts if none is blank, else the trimmed name, else NULL."""
    parts = [stripped(c) for c in (entity, action, behavior)]
    whole = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    named = stripped(name)
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(F.concat_ws(" ", *parts).alias("text"), F.lit("intent").alias("source"))).when(
        F.coalesce(named != "", F.lit(False)), F.struct(named.alias("text"), F.lit("name").alias("source"))
    )


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def full_name(value: Column) -> Column:
    """owner/name of a repository's address; NULL where blank."""
    out = stripped(value)
    out = F.regexp_replace(out, r"\Ahttps://github\.com/", "")
    out = F.regexp_replace(out, r"\.git\z", "")
    return presence(F.regexp_replace(out, r"/\z", ""))


def full_name_valid(value: Column) -> Column:
    part = "[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
    return value.rlike(rf"\A{part}/{part}\z")


def last_segment(value: Column) -> Column:
    return F.substring_index(value, "/", -1)


def _escaped(value: Column) -> Column:
    """Each path segment percent-encoded (a space as %20, a tilde and a star as themselves and %2A)."""
    one = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(F.split(value, "/"), one), "/")


def blob_url(name: Column, path: Column, line: Column, ref: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), name, F.lit("/blob/"), _escaped(ref), F.lit("/"), _escaped(path), F.lit("#L"), line.cast("string"))


def handle(value: Column) -> Column:
    return F.lower(stripped(value))


def handle_valid(value: Column) -> Column:
    return value.rlike(r"\A[a-z0-9](?:[a-z0-9]|-(?=[a-z0-9])){0,38}\z")


def _tenths(x: Column) -> Column:
    """Rounded to one digit as Ruby's Float#round does: halves away from zero, decided on the nearest doubles."""
    size = F.abs(x)
    whole = F.floor(size * 10) + F.when(size * 10 - F.floor(size * 10) >= 0.5, 1).otherwise(0)
    whole = F.when((whole + 0.5) / 10.0 <= size, whole + 1).otherwise(whole)
    return F.when(x < 0, -whole / 10.0).otherwise(whole / 10.0)


def two_digits(x: Column) -> Column:
    """C's '%.2f': the double's exact value to the nearest hundredth, exact halves to the even one.

    ``x * 100`` is taken with its rounding error, which splitting ``x`` into two short halves gives exactly.
    """
    size = F.abs(x)
    product = size * 100
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * 100 - product) + (size - high) * 100
    whole = F.floor(product)
    over = product - whole - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    text = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text)


def humanized_seconds(seconds: Column) -> Column:
    """12.3s under a minute, else hours, minutes and whole seconds, without zero parts."""
    rounded = _tenths(F.coalesce(seconds, F.lit(0.0)))
    whole = F.round(rounded).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    parts = F.concat_ws(
        " ",
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
        F.when((minutes > 0) | (hours > 0), F.concat(minutes.cast("string"), F.lit("m"))),
        F.when(rest > 0, F.concat(rest.cast("string"), F.lit("s"))),
    )
    return F.when(rounded < 60, F.concat(F.format_string("%.1f", rounded), F.lit("s"))).otherwise(parts)


def humanized_duration(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), "not reported")
        .when(seconds >= 60, humanized_seconds(seconds))
        .when((seconds > 0) & (seconds < 0.01), "< 0.01s")
        .otherwise(F.concat(two_digits(seconds), F.lit("s")))
    )


def seconds_per_test(value: Column) -> Column:
    millis = F.round(value * 1000, 1)
    return (
        F.when(value >= 1, F.concat(F.format_string("%.1f", F.round(value, 1)), F.lit("s/test")))
        .when(millis > 0, F.concat(F.format_string("%.1f", millis), F.lit("ms/test")))
        .when(value.isNotNull(), "under 0.1ms/test")
    )


def coverage_label(timed: Column, recorded: Column) -> Column:
    return F.concat(timed.cast("string"), F.lit(" of "), recorded.cast("string"))


def counted(n: Column, noun: str) -> Column:
    """1,234 examples; the noun without its s for one."""
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def signed_change(change: Column) -> Column:
    """+1,234, a true minus sign before a loss, and ±0."""
    return F.when(change == 0, "±0").otherwise(F.concat(F.when(change < 0, "−").otherwise("+"), F.format_number(F.abs(change), 0)))


def outcome_tone(outcome: Column) -> Column:
    return F.when(outcome == "failed", "error").when(outcome == "pending", "warning").when(outcome == "passed", "success").otherwise("neutral")


def truncated(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last three dots where something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def lexical(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


def ratio_percent(part: Column, whole: Column) -> Column:
    """A percentage to one digit, 0.0 of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.round(part / whole * 100, 1))


def ratio(part: Column, whole: Column) -> Column:
    """A share to three digits, NULL of nothing."""
    return F.when(F.coalesce(whole, F.lit(0)) != 0, F.round(part / whole, 3))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def scaled(value: Column, least: Column, most: Column, height: float) -> Column:
    """A sparkline's y: 0 at the top; flat series in the middle."""
    return F.when(least == most, F.lit(height / 2)).otherwise(F.lit(height) - F.try_divide(value - least, most - least) * height)


def clamped_percent(value: Column, whole: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.try_divide(value * 100.0, whole), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
