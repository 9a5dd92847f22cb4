"""Scalar functions as Column expressions: sizes, durations, formats, log lines and scheduler fields.

All are built-in functions, so they stay inside whole-stage code.  Texts that don't parse give null where the function
is lenient, and an error only in :func:`human_size`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest unsigned 64-bit number; sizes saturate there, and so are decimals.
U64 = "18446744073709551615"
SIZE = "decimal(38,0)"


def byte_size(text: Column) -> Column:
    """``16G`` and the like with decimal suffixes K, M, G, T; null if unparseable; saturates at 2^64 - 1."""
    t = F.trim(text)
    suffix = F.upper(F.regexp_extract(t, r"([KMGTkmgt])$", 1))
    number = F.trim(F.regexp_replace(t, r"[KMGTkmgt]$", ""))
    whole = F.when(number.rlike(r"^\+?[0-9]+$"), F.regexp_replace(number, r"^\+", "").try_cast(SIZE))
    times = F.when(suffix == "K", F.lit(10**3)).when(suffix == "M", F.lit(10**6)).when(suffix == "G", F.lit(10**9)).when(suffix == "T", F.lit(10**12)).otherwise(F.lit(1))
    return F.when(whole <= F.lit(U64).cast(SIZE), F.least((whole * times).cast(SIZE), F.lit(U64).cast(SIZE)))


def resource_number(text: Column) -> Column:
    """A resource value as a whole number: whole numbers below 0 are 0, fractions round up, texts are byte sizes."""
    number = text.try_cast("double")
    fraction = text.rlike(r"^\s*[+-]?([0-9]+\.[0-9]*|\.[0-9]+)\s*$")
    negative = text.rlike(r"^\s*-[0-9]+\s*$")
    return F.when(negative, F.lit(0).cast(SIZE)).when(fraction, F.greatest(F.ceil(number), F.lit(0)).cast(SIZE)).otherwise(byte_size(text))


def human_size(text: Column) -> Column:
    """``512M``, ``1GiB`` with binary suffixes; raises on anything else, as a budget must not be misread."""
    t = F.trim(text)
    suffix = F.upper(F.regexp_extract(t, r"^[0-9]+([A-Za-z]*)$", 1))
    number = F.regexp_extract(t, r"^([0-9]+)[A-Za-z]*$", 1).try_cast(SIZE)
    times = F.when(suffix == "", 1).when(suffix.isin("K", "KB", "KIB"), 1 << 10).when(suffix.isin("M", "MB", "MIB"), 1 << 20).when(suffix.isin("G", "GB", "GIB"), 1 << 30).when(suffix.isin("T", "TB", "TIB"), 1 << 40)
    bytes_ = F.when(number <= F.lit(U64).cast(SIZE), (number.cast("decimal(20,0)") * times.cast("decimal(15,0)")).cast(SIZE))
    bad = F.raise_error(F.concat(F.lit("invalid size: "), F.coalesce(text, F.lit("null"))))
    return F.when(bytes_ <= F.lit(U64).cast(SIZE), bytes_).otherwise(bad)


def duration_seconds(text: Column) -> Column:
    """``30s``, ``2m``, ``3h``, ``1d`` or bare seconds; null if unparseable."""
    t = F.trim(text)
    unit = F.regexp_extract(t, r"([smhd])$", 1)
    number = F.when(t.rlike(r"^\+?[0-9]+[smhd]?$"), F.regexp_extract(t, r"([0-9]+)", 1).try_cast("long"))
    return number * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)


def format_elapsed(seconds: Column) -> Column:
    """``Ns``, ``MmSs``, ``HhMmSs``, without padding."""
    h, m, s = _parts(seconds)
    return F.when(seconds < 60, F.format_string("%ds", seconds)).when(seconds < 3600, F.format_string("%dm%ds", F.expr("0L") + _div(seconds, 60), s)).otherwise(F.format_string("%dh%dm%ds", h, m, s))


def format_span(ms: Column) -> Column:
    """``Nms`` under a second, then ``Ns``, ``MmSs``, ``HhMm``."""
    seconds = _div(ms, 1000)
    h, m, s = _parts(seconds)
    return F.when(ms < 1000, F.format_string("%dms", ms)).when(seconds < 60, F.format_string("%ds", seconds)).when(seconds < 3600, F.format_string("%dm%ds", _div(seconds, 60), s)).otherwise(F.format_string("%dh%dm", h, m))


def format_duration(ms: Column) -> Column:
    """Tenths under a second (``<0.1s`` for none, ``1s`` from ten), ``Ns``, ``MmSSs``, ``HhMMm``."""
    tenths = _div(ms + 50, 100)
    seconds = _div(ms, 1000)
    h, m, s = _parts(seconds)
    small = F.when(tenths == 0, "<0.1s").when(tenths >= 10, "1s").otherwise(F.format_string("0.%ds", tenths))
    return F.when(ms < 1000, small).when(seconds < 60, F.format_string("%ds", seconds)).when(seconds < 3600, F.format_string("%dm%02ds", _div(seconds, 60), s)).otherwise(F.format_string("%dh%02dm", h, m))


def format_count(n: Column) -> Column:
    """Thousands by commas."""
    return F.format_number(n, 0)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    return _div(seconds, 3600), _div(seconds % 3600, 60), seconds % 60


def iso8601(seconds: Column) -> Column:
    """Unix seconds as UTC time; the session's zone has to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_line(text: Column) -> Column:
    """The last line that isn't blank, trimmed; null without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))


def json_map(text: Column) -> Column:
    """A JSON object of texts as a map; null if it isn't one."""
    return F.from_json(text, "map<string,string>")


def job_label(rule: Column, wildcards: Column) -> Column:
    """``rule`` or ``rule (k=v, k2=v2)`` with sorted keys, from a map."""
    pairs = F.transform(F.array_sort(F.map_entries(wildcards)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(wildcards), F.lit(0)) <= 0, rule).otherwise(F.concat(rule, F.lit(" ("), F.array_join(pairs, ", "), F.lit(")")))


def batch_exit_code(text: Column) -> Column:
    """``exit:signal`` as the exit code, -1 if it isn't a number."""
    return F.coalesce(F.element_at(F.split(text, ":"), 1).try_cast("int"), F.lit(-1))


def max_rss(text: Column) -> Column:
    """``1024K``, ``2G`` (binary) or bytes; null if unparseable."""
    t = F.trim(text)
    unit = F.regexp_extract(t, r"([KMG])$", 1)
    number = F.when(t.rlike(r"^[0-9]+[KMG]?$"), F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long"))
    return number * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("long")


def batch_elapsed(text: Column) -> Column:
    """``H:M:S`` or ``M:S`` in seconds; parts that aren't numbers, and other shapes, count 0."""
    parts = F.transform(F.split(text, ":"), lambda x: F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("long")), F.lit(0).cast("long")))
    return F.when(F.size(parts) == 3, parts[0] * 3600 + parts[1] * 60 + F.get(parts, F.lit(2))).when(F.size(parts) == 2, parts[0] * 60 + F.get(parts, F.lit(1))).otherwise(F.lit(0).cast("long"))


def array_task(text: Column) -> Column:
    """``parent_task`` or ``parent`` as a struct; null if either isn't a number."""
    fine = text.rlike(r"^[0-9]+(_[0-9]+)?$")
    return F.when(fine, F.struct(F.regexp_extract(text, r"^([0-9]+)", 1).try_cast("long").alias("parent"), F.nullif(F.regexp_extract(text, r"_([0-9]+)$", 1), F.lit("")).try_cast("long").alias("task")))


#: What the states of the public batch scheduler mean; any other is taken as running.
BATCH_STATES = {
    "PENDING": "queued", "REQUEUED": "queued", "SUSPENDED": "queued", "CONFIGURING": "queued",
    "RUNNING": "running", "COMPLETING": "running", "RESIZING": "running", "STAGE_OUT": "running",
    "COMPLETED": "completed",
    "FAILED": "failed", "OUT_OF_MEMORY": "failed", "TIMEOUT": "failed", "DEADLINE": "failed", "NODE_FAIL": "failed", "BOOT_FAIL": "failed",
    "CANCELLED": "cancelled", "PREEMPTED": "cancelled", "REVOKED": "cancelled",
}


def batch_status(state: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BATCH_STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, state), F.lit("running"))


def memory_bytes(text: Column) -> Column:
    """``1.5GB`` and the like with binary suffixes, leniently: no number is 0, an unknown suffix counts 1."""
    t = F.trim(text)
    number = F.coalesce(F.regexp_extract(t, r"^([0-9.]*)", 1).try_cast("double"), F.lit(0.0))
    suffix = F.upper(F.trim(F.regexp_replace(t, r"^[0-9.]*", "")))
    times = F.when(suffix.isin("K", "KB", "KIB"), 1 << 10).when(suffix.isin("M", "MB", "MIB"), 1 << 20).when(suffix.isin("G", "GB", "GIB"), 1 << 30).when(suffix.isin("T", "TB", "TIB"), 1 << 40).otherwise(1)
    return (number * times).cast("long")


def kwarg_literal(value: str) -> str:
    """How a parameter's text is written in a call: numbers bare, true and false as booleans, the rest quoted."""
    for kind in (int, float):
        try:
            kind(value)
        except ValueError:
            continue
        return value
    return {"true": "True", "false": "False"}.get(value, repr(value))
