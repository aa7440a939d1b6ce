"""Timestamp text -> UTC instant (X5) and date-argument validation.

The source hands post/comment time text to a general-purpose date parser
relative to "now". Here the accepted forms are a closed list, tried in order,
relative to an explicit ``base`` column (so replays give the same answer);
anything else is NULL.

Accepted forms:
  * ISO-8601 date or date-time, optional fraction and offset (converted to UTC)
  * ``2024/01/05``
  * ``January 5, 2024 at 3:04 PM`` / ``January 5, 2024, 3:04 PM`` / ``January 5, 2024`` and the
    same as ``5 January 2024``; 12- or 24-hour clock; a weekday may stand before
  * ``March 3 at 5:00 PM`` / ``March 3`` (year taken from ``base``)
  * ``<n> <unit>[s] [ago]`` with units sec/s, min/m, hr/h/hour, day/d, week/w,
    month/mo, year/y/yr (``2 hrs ago``, ``1 day``, ``5m``, ``an hour ago``), also of two units
    (``1 hour 5 minutes ago``), and ``last week`` / ``month`` / ``year``
  * ``Yesterday at 5:00 PM``, ``Today at 17:00``, ``Yesterday``, ``Today``
  * ``Monday at 5:00 PM``, ``Monday``: the last such day before ``base``
  * ``Just now`` / ``now``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"second": ("sec", "secs", "second", "seconds", "s"), "minute": ("min", "mins", "minute", "minutes", "m"),
          "hour": ("hr", "hrs", "hour", "hours", "h"), "day": ("day", "days", "d"), "week": ("week", "weeks", "w"),
          "month": ("mo", "mos", "month", "months"), "year": ("yr", "yrs", "year", "years", "y")}
_UNIT = "(" + "|".join(w for words in _UNITS.values() for w in words) + ")"
_REL = rf"^(\d+)\s*{_UNIT}\.?(?:,?\s+(?:and\s+)?(\d+)\s*{_UNIT}\.?)?(?:\s+ago)?$"
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_DAY = "(yesterday|today|" + "|".join(_DAYS) + ")"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
           "october", "november", "december")
# a date with a month name: day before or after it, perhaps a year, perhaps a clock
_MONTH = "(" + "|".join(m[:3] for m in _MONTHS) + ")(?:" + "|".join(m[3:] for m in _MONTHS if m[3:]) + ")?"
_NAMED = (rf"^(?:(\d{{1,2}}) )?{_MONTH}(?: (\d{{1,2}}))?(?:,? (\d{{4}}))?"
          r"(?:(?: at|,)? (\d{1,2}:\d{2}(?: [ap]m)?))?$")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` names it: a column expression
    that is reused is otherwise copied into the plan at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _back(base: Column, n: Column, unit: Column) -> Column:
    """``base`` less ``n`` units; ``base`` itself where no unit is given."""
    zero = F.lit(0)
    steps = {"second": F.make_dt_interval(zero, zero, zero, n.cast("decimal(18,6)")), "minute": F.make_dt_interval(zero, zero, n),
             "hour": F.make_dt_interval(zero, n), "day": F.make_dt_interval(n), "week": F.make_dt_interval(n * 7),
             "month": F.make_ym_interval(zero, n), "year": F.make_ym_interval(n, zero)}
    out = F.when(F.coalesce(unit, F.lit("")) == "", base)
    for name, step in steps.items():
        out = out.when(unit.isin(*_UNITS[name]), base - step)
    return out


def _ntz(c: Column) -> Column:
    # a pattern parse gives the text's wall clock in the session zone; casting back
    # to NTZ in the same zone returns that wall clock unchanged
    return c.cast("timestamp_ntz")


def _fmt(s: Column, pattern: str) -> Column:
    return _ntz(F.try_to_timestamp(s, F.lit(pattern)))


def parse_time_text(text: Column, base: Column) -> Column:
    """Parse ``text`` relative to ``base`` (TIMESTAMP_NTZ, UTC); NULL on failure."""
    s = F.regexp_replace(F.trim(text), r"\s+", " ")
    s = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    # a weekday before a full date says nothing more
    s = F.regexp_replace(s, rf"(?i)^({'|'.join(_DAYS)}),? (?!at\b)(?=[a-z0-9])", "")
    # most rows have no text: for them none of the forms is tried
    return F.when(text.isNotNull(), bind(
        F.struct(s.alias("s"), base.alias("base")),
        lambda v: bind(F.struct(v["s"].alias("s"), F.lower(v["s"]).alias("low"), v["base"].alias("base")),
                       lambda b: _parsed(b["s"], b["low"], b["base"]))))


def _parsed(s: Column, low: Column, base: Column) -> Column:
    now = F.when(low.isin("just now", "now"), base)
    return F.coalesce(now, _relative(low, base), _day_word(low, base), _iso(s), _named_date(low, base))


def _iso(s: Column) -> Column:
    """With an explicit offset it is an instant: its UTC wall clock, whatever the session time
    zone; without one the text already is UTC wall-clock time."""
    has_offset = s.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & s.rlike(r"\d[T ]\d")
    instant = _ntz(s.try_cast("timestamp"))
    return F.when(has_offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)) \
        .otherwise(s.try_cast("timestamp_ntz"))


def _clock(day: Column, clock: Column) -> Column:
    """``day`` (yyyy-MM-dd) at a 12- or 24-hour clock text; midnight where it is empty."""
    return F.when(clock == "", day.try_cast("timestamp_ntz")).otherwise(bind(
        F.concat(day, F.lit(" "), F.upper(clock)),
        lambda at: F.when(at.endswith("M"), _fmt(at, "yyyy-MM-dd h:mm a")).otherwise(_fmt(at, "yyyy-MM-dd H:mm"))))


def _named_date(low: Column, base: Column) -> Column:
    part = lambda i: F.regexp_extract(low, _NAMED, i)
    parts = F.struct(*[part(i).alias(n) for i, n in enumerate(("before", "month", "after", "year", "clock"), 1)])
    months = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m[:3], f"{i:02d}")])

    def dated(p: Column) -> Column:
        year = F.when(p["year"] == "", F.year(base).cast("string")).otherwise(p["year"])
        day = F.concat_ws("-", year, months[p["month"]], F.lpad(F.concat(p["before"], p["after"]), 2, "0"))
        one_day = (p["before"] == "") != (p["after"] == "")
        return F.when((p["month"] != "") & one_day, bind(day, lambda d: _clock(d, p["clock"])))

    return F.when(low.rlike(_MONTH), bind(parts, dated))


def _relative(low: Column, base: Column) -> Column:
    def back(p: Column) -> Column:
        return F.when(p["u1"] != "", bind(_back(base, p["n1"].try_cast("int"), p["u1"]),
                                          lambda t: _back(t, p["n2"].try_cast("int"), p["u2"])))

    def counted(c: Column) -> Column:
        names = enumerate(("n1", "u1", "n2", "u2"), 1)
        return bind(F.struct(*[F.regexp_extract(c, _REL, i).alias(n) for i, n in names]), back)

    some = F.regexp_replace(low, rf"^(an?|one) (?={_UNIT}\b)", "1 ")
    last = F.regexp_extract(low, r"^last (week|month|year)$", 1)
    return F.when(low.startswith("last "), bind(last, lambda u: F.when(u != "", _back(base, F.lit(1), u)))) \
        .otherwise(bind(some, lambda c: F.when(c.rlike(r"^\d"), counted(c))))


def _day_word(low: Column, base: Column) -> Column:
    def told(p: Column) -> Column:
        today = F.to_date(base)
        day = F.when(p["word"] == "yesterday", F.date_sub(today, 1)).when(p["word"] == "today", today)
        for name in _DAYS:  # the last one before the base day
            day = day.when(p["word"] == name, F.next_day(F.date_sub(today, 8), name[:3]))
        return bind(F.date_format(day, "yyyy-MM-dd"), lambda d: _clock(d, p["clock"]))

    pattern = rf"^{_DAY}(?: at (.+))?$"
    parts = F.struct(F.regexp_extract(low, pattern, 1).alias("word"), F.regexp_extract(low, pattern, 2).alias("clock"))
    return bind(parts, lambda p: F.when(p["word"] != "", told(p)))


def valid_date_arg(s: Column) -> Column:
    """empty/NULL is valid, else ``YYYY-MM-DD`` (single-digit month/day allowed)."""
    return s.isNull() | (s == "") | F.try_to_timestamp(s, F.lit("yyyy-M-d")).isNotNull()


def observe_rejects(df, text_col: str, parsed_col: str, name: str = "time_text_rejects"):
    """X5 reject count: rows whose time text is present but did not parse, observed
    while the job that consumes ``df`` runs (no extra pass). Returns (df, Observation)."""
    from agora.operators.stats import run_counters
    bad = F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != "") & F.col(parsed_col).isNull()
    return run_counters(df, name, rejected=F.count_if(bad), with_text=F.count(F.col(text_col)))
