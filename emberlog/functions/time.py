"""Strict timestamps as columns: parsing to UTC, formatting, durations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY, _CLOCK = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
#: A day and a time of day, perhaps with a fraction of up to 6 digits, perhaps with an offset.
_MOMENT = rf"{_DAY}[T ]{_CLOCK}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:\d{{2}})?"
ISO, LEADING_ISO = rf"(?i)^{_MOMENT}$", rf"(?i)^\s*({_MOMENT})"
LEADING_SYSLOG = rf"^[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+{_CLOCK}\b"
#: The months as syslog writes them.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
UNRECOGNISED, NONEXISTENT = "unrecognised timestamp", "nonexistent date"


def _fixed_seconds(zone: str) -> int | None:
    """Seconds east of UTC of UTC, Z or an offset with or without a colon, None for an IANA name. Other names raise ValueError."""
    name = zone.strip()
    if name.upper() in ("UTC", "Z"):
        return 0
    digits = name[1:].replace(":", "", 1) if len(name) == 6 and name[3] == ":" else name[1:]
    if name[:1] in ("+", "-") and len(digits) == 4 and digits.isascii() and digits.isdigit():
        hours, minutes = divmod(int(digits), 100)
        if hours < 24 and minutes < 60:
            return (hours * 3600 + minutes * 60) * (-1 if name[0] == "-" else 1)
    if name not in available_timezones():
        raise ValueError(f"{zone!r} is no time zone: UTC, Z, an offset or an IANA name is needed")
    return None


def zone_of(name: str) -> tzinfo:
    """The zone of a name: UTC, Z, an offset or an IANA name; other names raise ValueError."""
    east = _fixed_seconds(name)
    return ZoneInfo(name.strip()) if east is None else timezone(timedelta(seconds=east))


def _shifted(utc: Column, zone: str) -> Column:
    """The instant at which clocks of a zone show what UTC's show at `utc`. A repeated hour means its first occurrence."""
    fixed = _fixed_seconds(zone)
    if fixed is None:
        return F.to_utc_timestamp(utc, zone.strip())
    return utc - F.expr(f"interval {fixed} seconds") if fixed else utc


def iso_timestamp(text: Column, zone: str = "UTC") -> Column:
    """The UTC instant of strict ISO 8601 text, null if it isn't; blanks around it don't count.

    The text without its offset is read once, as a time of UTC, and moved by the offset, or else by the zone: so the
    code that Spark makes of it stays short.
    """
    t = F.upper(F.trim(text))
    ends = lambda *c: F.substring(t, -6, 1).isin(*c)  # noqa: E731  only an offset has its sign there
    clock = F.when(F.endswith(t, F.lit("Z")), t).otherwise(F.concat(F.when(ends("+", "-"), F.substring(t, F.lit(1), F.char_length(t) - 6)).otherwise(t), F.lit("Z")))
    utc = clock.try_cast("timestamp")
    hours, minutes = F.substring(t, -5, 2).try_cast("int"), F.substring(t, -2, 2).try_cast("int")
    east = F.when((hours < 24) & (minutes < 60), F.make_dt_interval(F.lit(0), hours, minutes))
    moved = F.when(ends("+"), utc - east).when(ends("-"), utc + east).when(F.endswith(t, F.lit("Z")), utc).otherwise(_shifted(utc, zone))
    return F.when(t.rlike(ISO) & ~F.startswith(t, F.lit("0000")), moved)


def iso_error(text: Column, value: Column) -> Column:
    """Why iso_timestamp gave no value: not the format, or no such date. Null if there is a value."""
    return F.when(value.isNotNull(), F.lit(None)).when(F.trim(text).rlike(ISO), F.lit(NONEXISTENT)).otherwise(F.lit(UNRECOGNISED))


def month_number(name: Column) -> Column:
    """1 to 12 for the English three-letter names, else null."""
    place = F.instr(F.lit(" ".join(MONTHS)), name)
    return F.when((F.char_length(name) == 3) & (place % 4 == 1), ((place + 3) / 4).cast("int"))


def syslog_timestamp(month: Column, day: Column, at: Column, year: int, zone: str = "UTC") -> Column:
    """The UTC instant of a syslog date (month name, day, HH:MM:SS) in an assumed year, null if there is none."""
    date = F.concat_ws("-", F.lit(f"{year:04}"), F.coalesce(month_number(month).cast("string"), F.lit("?")), day)
    return _shifted(F.concat(date, F.lit(" "), at, F.lit("Z")).try_cast("timestamp"), zone)


def leading_texts(text: Column) -> tuple[Column, Column]:
    """What may be a timestamp at the start of a line: as ISO (blanks may stand before it) and as syslog writes it; empty if there is none."""
    return F.regexp_extract(text, LEADING_ISO, 1), F.regexp_extract(text, LEADING_SYSLOG, 0)


def leading_instant(iso: Column, old: Column, year: int, zone: str = "UTC") -> Column:
    """The UTC instant of leading_texts: of the ISO text if there is one, else of syslog's."""
    part = F.split(old, r"\s+")
    syslog = F.when(old != "", syslog_timestamp(F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2)), year, zone))
    return F.when(iso != "", iso_timestamp(iso, zone)).otherwise(syslog)


def leading_timestamp(text: Column, year: int, zone: str = "UTC") -> Column:
    """The UTC instant at the start of a line: ISO (blanks may stand before it), else syslog. Null if there is none."""
    return leading_instant(*leading_texts(text), year, zone)


def format_timestamp(ts: Column, zone: str = "UTC") -> Column:
    """YYYY-MM-DD HH:MM:SS+HH:MM in a zone."""
    fixed = _fixed_seconds(zone)
    local = F.timestamp_micros(F.unix_micros(ts) + fixed * 1_000_000) if fixed is not None else F.from_utc_timestamp(ts, zone.strip())
    east = F.floor((F.unix_micros(local) - F.unix_micros(ts)) / 60_000_000)
    ahead = F.abs(east)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.when(east < 0, "-").otherwise("+"), F.lpad(F.floor(ahead / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((ahead % 60).cast("string"), 2, "0"))


def iso_seconds(ts: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS+00:00 of a UTC instant, without its fraction."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def local_day(ts: Column, zone: str = "UTC") -> Column:
    fixed = _fixed_seconds(zone)
    return F.to_date(F.timestamp_micros(F.unix_micros(ts) + fixed * 1_000_000) if fixed is not None else F.from_utc_timestamp(ts, zone.strip()))


def local_hour(ts: Column, zone: str = "UTC") -> Column:
    """The hour of the day, 0 to 23, that clocks of a zone show."""
    fixed = _fixed_seconds(zone)
    return F.hour(F.timestamp_micros(F.unix_micros(ts) + fixed * 1_000_000) if fixed is not None else F.from_utc_timestamp(ts, zone.strip()))


def to_utc(local: Column, zone: str) -> Column:
    """The instant of a local timestamp in a zone; a repeated hour means its first occurrence."""
    fixed = _fixed_seconds(zone)
    return F.timestamp_micros(F.unix_micros(local) - fixed * 1_000_000) if fixed is not None else F.to_utc_timestamp(local, zone.strip())


def format_duration(seconds: Column) -> Column:
    """`1 h 0 min 5 s`, `3 min 28 s` or `9 s` of whole seconds."""
    s = seconds.cast("bigint")
    h, m, rest = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit(" h "), m, F.lit(" min "), rest, F.lit(" s"))).when(s >= 60, F.concat(m, F.lit(" min "), rest, F.lit(" s"))).otherwise(F.concat(rest, F.lit(" s")))


def minutes_text(delta: timedelta) -> str:
    """A length of time in minutes, such as `1.5 min`."""
    return f"{delta / timedelta(minutes=1):g} min"


def date_bound(text: str, zone: str = "UTC", end: bool = False) -> datetime:
    """A bound of a date search in UTC: the moment itself, or a day's first microsecond, for `end` its last, in the zone.

    Raises ValueError if text is neither a day nor a moment.
    """
    value, length = text.strip(), timedelta()
    if re.fullmatch(_DAY, value) and end:
        length = timedelta(days=1) - timedelta.resolution
    elif not re.fullmatch(f"(?i)(?:{_DAY}|{_MOMENT})", value):
        raise ValueError(f"neither a day nor a moment: {text!r}")
    local = datetime.fromisoformat(value.upper()) + length
    return (local if local.tzinfo else local.replace(tzinfo=zone_of(zone))).astimezone(timezone.utc)
