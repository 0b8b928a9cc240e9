"""Timestamps in mixed formats, precisions and zones, turned into UTC microseconds.

Everything here is a JVM-side expression; no Python runs per row. The result for each kind of value:

* null, blank, or no existing date and time (30 February, hour 25, a wall time that a clock change skips): null;
* digits only: seconds since 1970, above 10^11 milliseconds, above 10^14 microseconds; digits with a fraction: seconds;
* ``Z``, an offset, a zone name or an abbreviation: taken by it; the abbreviation as the source's own zone uses it,
  else by the one offset on which all zones that use it today agree, else null;
* any other value: wall time in the source's zone (null zone: UTC; an unknown zone name: null); a wall time that
  occurs twice is its first occurrence;
* digits beyond microseconds are dropped; a date without a time of day tells no instant: null.
"""

from __future__ import annotations

import functools
import json
import zoneinfo
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.commits import Commits
from siltbed.session import broadcast_if_small, materialise

#: The form in which a value is already normal.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"

BLANKS = " \t\r\n\f\u000b\u0085       　﻿"

# First three letters of month names, lower case: English, then where German, French, Spanish, Portuguese, Italian and Dutch differ.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "fév": 2, "fev": 2, "avr": 4, "aoû": 8, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
    "set": 9, "out": 10, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "ott": 10, "mei": 5,
}

# Territories that write the month before the day, and languages that write the year first and then the month.
MONTH_FIRST_REGIONS = ("US", "PH", "PR", "GU", "AS", "MP", "VI", "UM", "FM", "PW", "MH")
YEAR_FIRST_LANGUAGES = ("ja", "ko", "zh", "hu", "lt", "mn")

_TIME = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(Z|z|(?:UTC|GMT|utc|gmt)?\s*[+\-−][0-9]{1,2}(?::?[0-9]{2})?|[A-Za-z]{2,5}|[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)?(?:\s*[\[(][^\])]*[\])])?"
_DAY = r"(?:\p{L}{2,12}\.?,?\s+)?"
# Each form and how its groups are rearranged: year, month, day, hour, minute, second, fraction, a/p, zone, day and month by locale.
FORMS = (
    (rf"^([0-9]{{4}})([-/.])([0-9]{{1,2}})\2([0-9]{{1,2}})(?:[Tt]|,?\s+){_TIME}\s*{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|"),
    (rf"^([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2([0-9]{{4}})(?:[Tt]|,?\s+){_TIME}\s*{_ZONE}$", "$4|$3|$1|$5|$6|$7|$8|$9|$10|L"),
    (rf"^{_DAY}(\p{{L}}{{3,12}})\.?\s+([0-9]{{1,2}})\s+{_TIME}\s+(?:{_ZONE}\s+)?([0-9]{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8|"),
    (rf"^{_DAY}([0-9]{{1,2}})\.?[\s-]+(\p{{L}}{{3,12}})\.?[\s-]+([0-9]{{4}}),?\s+{_TIME}\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"^{_DAY}(\p{{L}}{{3,12}})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}),?\s+{_TIME}\s*{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt ]([0-9]{{2}}):?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,]([0-9]+))?)?()\s*{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
)


@functools.lru_cache
def zone_names() -> tuple[str, ...]:
    """Every zone of the tz database; a fixed number, not one of the data."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT", "EST", "MST", "HST", "Japan", "Singapore")))


@functools.lru_cache
def abbreviations() -> dict[str, int]:
    """'zone|ABBREVIATION' -> offset in seconds as last used there, and '|ABBREVIATION' where all zones that
    have used it since 2010 agree. Built from the tz database by sampling each month."""
    own: dict[str, int] = {}
    shared: dict[str, set[int]] = {}
    moments = [datetime(year, month, 15, tzinfo=timezone.utc) for year in range(1970, 2031) for month in range(1, 13)]
    for name in zone_names():
        zone = zoneinfo.ZoneInfo(name)
        for moment in moments:
            local = moment.astimezone(zone)
            short = local.tzname() or ""
            if short.isalpha():
                seconds = int((local.utcoffset() or timedelta()).total_seconds())
                own[f"{name}|{short.upper()}"] = seconds
                if moment.year >= 2010:
                    shared.setdefault(short.upper(), set()).add(seconds)
    return own | {f"|{short}": offsets.pop() for short, offsets in shared.items() if len(offsets) == 1} | {"|UTC": 0, "|GMT": 0, "|UT": 0}


def _constant_map(values: dict, kind: str) -> Column:
    """A literal map; the optimiser folds it to a constant."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"map<string,{kind}>")


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def month_first(locale: Column) -> Column:
    parts = F.split(F.coalesce(locale, F.lit("")), "[-_]")
    return F.coalesce(F.upper(F.try_element_at(parts, F.lit(-1))).isin(*MONTH_FIRST_REGIONS) | F.lower(parts[0]).isin(*YEAR_FIRST_LANGUAGES), F.lit(False))


def with_instant(df: DataFrame, raw: str, zone: str, locale: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the UTC microseconds of ``raw`` (see the module), null where it is unreadable.

    Built in stages, each a projection over the columns of the one before, so that no expression is evaluated twice.
    """
    text, part = F.col("__i_text"), F.col("__i_part")
    laid = F.lit(None).cast("string")
    for form, groups in reversed(FORMS):
        laid = F.when(text.rlike(form), F.regexp_replace(text, form, F.lit(groups))).otherwise(laid)
    fraction = lambda c: F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    at = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("int")
    word = lambda i: F.try_element_at(part, F.lit(i + 1))

    df = df.withColumn("__i_text", F.btrim(F.col(raw), F.lit(BLANKS)))
    df = df.withColumn("__i_laid", laid)
    df = df.withColumn("__i_part", F.split("__i_laid", r"\|"))
    df = df.withColumns({"__i_swap": (word(9) == "L") & month_first(F.col(locale)), "__i_half": F.lower(word(7)), "__i_shown": F.regexp_replace(F.regexp_replace(word(8), "−", "-"), r"\s", "")})
    df = df.withColumns({
        "__i_month": F.when(F.col("__i_swap"), at(2)).otherwise(F.coalesce(at(1), F.try_element_at(_constant_map(MONTHS, "int"), F.lower(F.substring(word(1), 1, 3))))),
        "__i_day": F.when(F.col("__i_swap"), at(1)).otherwise(at(2)),
        "__i_hour": F.when(F.col("__i_half") == "", at(3)).when(at(3).between(1, 12), at(3) % 12 + F.when(F.col("__i_half") == "p", 12).otherwise(0)),
        "__i_second": F.coalesce(at(5), F.lit(0)),
    })
    month, day, hour, second = (F.col(f"__i_{c}") for c in ("month", "day", "hour", "second"))
    date = F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", word(0), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))).try_cast("date")
    df = df.withColumn("__i_date", date)
    clock = ((hour * 60 + at(4)) * 60 + second).cast("bigint") * 1_000_000 + fraction(word(6))
    df = df.withColumn("__i_local", F.when(hour.between(0, 23) & at(4).between(0, 59) & second.between(0, 59), F.unix_date("__i_date").cast("bigint") * 86_400_000_000 + clock))

    local, shown = F.col("__i_local"), F.col("__i_shown")
    offset_form = r"^(?i:UTC|GMT)?([+-])([0-9]{1,2}):?([0-9]{2})?$"
    hours = F.regexp_extract(shown, offset_form, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(shown, offset_form, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(shown, offset_form, 1) == "-", -60).otherwise(60)
    own = F.coalesce(F.col(zone), F.lit("UTC"))
    shift = _constant_map(abbreviations(), "int")
    df = df.withColumns({
        "__i_wall": F.when(shown == "", own).when(F.instr(shown, "/") > 0, shown),
        "__i_offset": F.when(F.upper(shown) == "Z", 0).when(shown.rlike(offset_form), F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * sign))
        .when(shown.rlike("^[A-Za-z]+$"), F.coalesce(F.try_element_at(shift, F.concat(own, F.lit("|"), F.upper(shown))), F.try_element_at(shift, F.concat(F.lit("|"), F.upper(shown))))),
    })
    df = df.withColumn("__i_wall", F.when(F.expr(f"__i_wall IN ({_quoted(zone_names())})"), F.col("__i_wall")))
    df = df.withColumn("__i_utc", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("__i_wall"))))
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("__i_utc")), F.col("__i_wall")))
    calendar = F.when(F.col("__i_offset").isNotNull(), local - F.col("__i_offset").cast("bigint") * 1_000_000).when(back == local, F.col("__i_utc"))
    number = text.try_cast("bigint")
    digits = F.when(number > 10**14, number).when(number > 10**11, number * 1000).otherwise(number * 1_000_000)
    whole = F.regexp_extract(text, r"^([0-9]{1,12})[.,][0-9]+$", 1).try_cast("bigint")
    decimal = whole * 1_000_000 + fraction(F.regexp_extract(text, r"[.,]([0-9]+)$", 1))
    df = df.withColumn(out, F.when(text.rlike("^[0-9]+$"), digits).when(text.rlike(r"^[0-9]+[.,][0-9]+$"), decimal).otherwise(calendar))
    return df.drop(*(c for c in df.columns if c.startswith("__i_")))


def number_micros(raw: Column) -> Column:
    """Microseconds of a whole number in text: above 10^14 it is microseconds, above 10^11 milliseconds, else seconds."""
    n = raw.try_cast("bigint")
    return F.when(n > 10**14, n).when(n > 10**11, n * 1000).otherwise(n * 1_000_000)


def flexible_text(raw: Column) -> Column:
    """A time as a document holds it, as text: a whole number becomes RFC 3339 with as many digits of the second as it
    needs, anything else stays as it is."""
    micros = number_micros(raw)
    stamp = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.rtrim(F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("0"))
    return F.when(raw.rlike("^-?[0-9]{1,18}$"), F.concat(stamp, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))).otherwise(raw)


def rfc3339_micros(raw: Column) -> Column:
    """Microseconds of an RFC 3339 time, 0 for anything else; a bare date is none."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
    return F.coalesce(F.when(raw.rlike(form), F.unix_micros(F.try_to_timestamp(F.regexp_replace(raw, r"(\.\d{6})\d*", "$1")))), F.lit(0))


class InstantDictionary:
    """The distinct (raw, zone, locale) values met so far with their instants, each parsed once, as a table that grows by
    commits (see ``commits``) of the values not yet in it. A run that finds its commit taken by another looks again for
    what is new, so no value is in it twice.

    ``path`` may be None: the dictionary then lives in the shared folder for this run only.
    """

    SCHEMA = "raw string, zone string, locale string, utc_us bigint"

    def __init__(self, spark, path: str | None = None):
        self.spark, self.log = spark, Commits(spark, path) if path else None

    def stored(self) -> DataFrame:
        return self.log.tables([self.log.read(n)["data"] for n in self.log.numbers()], self.SCHEMA)

    def extend(self, values: DataFrame, attempts: int = 5) -> DataFrame:
        """Add the values of ``values`` (raw, zone, locale) and return the whole dictionary."""
        distinct = values.select("raw", "zone", "locale").distinct()
        if self.log is None:
            return materialise(with_instant(distinct, "raw", "zone", "locale", "utc_us"), "instants")
        for _ in range(attempts):
            last, _state = self.log.latest()
            new = distinct.join(self.stored().select("raw", "zone", "locale"), ["raw", "zone", "locale"], "left_anti") if last else distinct
            data = self.log.stage()
            with_instant(new, "raw", "zone", "locale", "utc_us").write.option("compression", "zstd").parquet(data)
            if self.log.commit(last + 1, {"data": data}):
                return self.stored()
        raise RuntimeError(f"{attempts} commits in a row were taken by other runs")


def normalise_instants(rows: DataFrame, raw: str | list[str], zone: str, locale: str, out: str | list[str] = "utc_us", dictionary: InstantDictionary | None = None) -> DataFrame:
    """``rows`` with column ``out``: the instant of ``raw`` in UTC microseconds, by way of the dictionary. Several raw
    columns, with as many out, share one dictionary.

    Values without a digit tell no instant and never reach the dictionary, so that a hot '', 'null' or 'n/a' moves
    nowhere. The dictionary holds one row per distinct value; it is joined by broadcast below the checked size and
    by a shuffle beyond, where adaptive execution splits hot values on the side of the rows. ``rows`` is evaluated
    twice: materialise it first where that is dear.
    A column of ``rows`` named ``out`` is replaced; all others stay. Empty input gives an empty result.
    """
    raws, outs = ([raw], [out]) if isinstance(raw, str) else (raw, out)
    rows = rows.drop(*outs)
    own = {"__zone": F.coalesce(F.col(zone), F.lit("UTC")), "__locale": F.coalesce(F.col(locale), F.lit(""))}
    keyed = rows.withColumns(own | {f"__raw{i}": F.when(F.col(r).rlike("[0-9]"), F.col(r)) for i, r in enumerate(raws)})
    values = keyed.select(F.explode(F.array(*[f"__raw{i}" for i in range(len(raws))])).alias("raw"), F.col("__zone").alias("zone"), F.col("__locale").alias("locale"))
    known = (dictionary or InstantDictionary(rows.sparkSession)).extend(values.where("raw is not null"))
    for i, column in enumerate(outs):
        entry = known.select(F.col("raw").alias(f"__raw{i}"), F.col("zone").alias("__zone"), F.col("locale").alias("__locale"), F.col("utc_us").alias(column))
        keyed = keyed.join(broadcast_if_small(entry, 2 << 20), [f"__raw{i}", "__zone", "__locale"], "left")
    return keyed.drop(*own, *[f"__raw{i}" for i in range(len(raws))])
