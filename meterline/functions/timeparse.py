"""Times and durations from loose text, and the two calendars."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.functions.text import tidy
from meterline.schema import HEALTH_STEP_MINUTES, LOCAL_OFFSET_HOURS, MISSING_DAY, MISSING_HOUR

# --- fixed values: duration units in nanoseconds -------------------------------------------
UNIT_NANOS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 1000000,
              "s": 1000000000, "m": 60000000000, "h": 3600000000000}
# --- end of fixed values -------------------------------------------------------------------

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def micros_to_ntz(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def ntz_to_micros(ts: Column) -> Column:
    """Microseconds since 1970 without regard to any zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def number_to_ntz(v: Column) -> Column:
    """Seconds, milliseconds or nanoseconds since 1970, told apart by size."""
    size = F.abs(v)
    micros = (F.when(size >= 1e17, F.floor(v / 1e3))
              .when(size >= 1e12, F.round(v * 1e3))
              .otherwise(F.round(v * 1e6)))
    bad = v.isNull() | F.isnan(v) | (v == 0) | (size == float("inf"))
    return F.when(~bad, micros_to_ntz(micros.cast("bigint")))


def norm_time(raw: Column) -> Column:
    """RFC 3339 text or a number; NULL when missing or unreadable."""
    v = tidy(raw)
    instant = F.try_to_timestamp(F.when(v.rlike(_RFC3339), v))
    wall = F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.when(v.rlike(_RFC3339), wall).otherwise(number_to_ntz(v.try_cast("double")))


_UNITS = "|".join(sorted(UNIT_NANOS, key=len, reverse=True))
_PIECE = rf"(\d+\.?\d*|\.\d+)({_UNITS})"
_DURATION = rf"^[+-]?(?:{_PIECE})+$"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def is_time(raw: Column) -> Column:
    """Readable as a time other than zero."""
    return raw.rlike(_RFC3339) | (raw.rlike(_NUMBER) & raw.rlike("[1-9]"))


def is_duration(raw: Column) -> Column:
    """Readable as a duration other than zero."""
    return raw.rlike("[1-9]") & raw.rlike(_DURATION + "|" + _NUMBER)


def norm_duration(raw: Column, unit_nanos: int | Column = 1) -> Column:
    """Duration text such as 1h2m3.5s, or a number of units, as nanoseconds (0 when unreadable)."""
    v = tidy(raw)
    factor = F.create_map(*[F.lit(x) for kv in UNIT_NANOS.items() for x in kv])
    counts = F.regexp_extract_all(v, F.lit(_PIECE), F.lit(1))
    names = F.regexp_extract_all(v, F.lit(_PIECE), F.lit(2))
    total = F.aggregate(
        F.transform(counts, lambda n, i: n.cast("double") * F.element_at(factor, F.get(names, i))),
        F.lit(0.0), lambda a, x: a + x)
    sign = F.when(v.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    unit = unit_nanos if isinstance(unit_nanos, Column) else F.lit(float(unit_nanos))
    number = v.try_cast("double") * unit
    nanos = F.when(v.rlike(_DURATION), total * sign).otherwise(
        F.when(~F.isnan(number) & (F.abs(number) != float("inf")), F.round(number)))
    return F.coalesce(nanos.cast("bigint"), F.lit(0).cast("bigint"))


def local(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS")


def local_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(local(ts), "yyyy-MM-dd"), F.lit(MISSING_DAY))


def local_hour(ts: Column) -> Column:
    return F.coalesce(F.hour(local(ts)), F.lit(MISSING_HOUR))


def local_timestamp(ts: Column) -> Column:
    """RFC 3339 at the fixed offset without trailing zeros in the fraction; '' when missing."""
    shown = F.date_format(local(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = F.regexp_replace(shown, r"\.?0*$", "")
    return F.coalesce(F.concat(shown, F.lit(f"+{LOCAL_OFFSET_HOURS:02d}:00")), F.lit(""))


def health_slot(ts: Column) -> Column:
    """Start of the quarter hour in UTC, as seconds since 1970."""
    step = HEALTH_STEP_MINUTES * 60
    secs = F.floor(ntz_to_micros(ts) / 1000000)
    return (F.floor(secs / step) * step).cast("bigint")
