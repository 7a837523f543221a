"""Mixed timestamp texts to UTC instants.

A text is taken apart by regular expressions (JVM side), giving a wall-clock time and, where the text has one, an offset or a zone
abbreviation. Wall-clock times without offset are joined as-of to intervals of constant UTC offset of their zone, exploded to one bucket per
local year. An interval's local start and end both carry its own offset, so two intervals that hold the time mean it occurs twice (the earlier
instant is taken), none means the clock skipped it (no instant), and one gives the offset.

The intervals come from the zone files: all recorded changes, and after the last of them the file's own rule. Before the first change a zone keeps
its first offset. A year beyond ``LAST_YEAR`` is read as one of the same calendar (first weekday, leap day) among the last 28, for which the rule
gives the same changes. So no year is cut off. The table holds one row per (zone, year); zones are IANA names, about 600, and there are fewer than
250 years, so its size is bounded whatever the data (some 8 MB for all zones) and it is broadcast.
"""

from __future__ import annotations

import importlib.resources
import re
import struct
import zoneinfo
from datetime import date, datetime, timedelta, timezone
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the last 28 years of the table hold each kind of calendar year after the recorded changes
LAST_YEAR, CYCLE = 2065, 28
_FAR = 4_000_000_000_000

# Month names by language, in order.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
# Nominatives that are no prefix of the genitive above, and Austrian names.
_MORE = {"pl": {"styczeń": 1, "luty": 2, "marzec": 3, "kwiecień": 4, "maj": 5, "czerwiec": 6, "lipiec": 7, "sierpień": 8, "wrzesień": 9, "październik": 10, "listopad": 11, "grudzień": 12}, "ru": {"январь": 1, "февраль": 2, "март": 3, "апрель": 4, "май": 5, "июнь": 6, "июль": 7, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12}, "de": {"jänner": 1, "feber": 2, "mrz": 3}}
EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def month_words() -> dict[str, int]:
    """``language|word`` to month: each name and each prefix of three letters or more that means one month in its language."""
    out: dict[str, int] = {}
    for lang, names in MONTHS.items():
        full = {name: i for i, name in enumerate(names.split(), 1)} | _MORE.get(lang, {})
        found: dict[str, set[int]] = {}
        for name, i in full.items():
            for n in range(3, len(name) + 1):
                found.setdefault(name[:n], set()).add(i)
        out |= {f"{lang}|{word}": min(months) for word, months in found.items() if len(months) == 1}
        out |= {f"{lang}|{name}": i for name, i in full.items()}
    return out


def _zone_file(zone: str) -> bytes:
    """The compiled zone file, of the system or of the tzdata package; raises for a name that is no zone."""
    if zone not in zoneinfo.available_timezones():
        raise KeyError(zone)
    for folder in zoneinfo.TZPATH:
        if (path := Path(folder) / zone).is_file():
            return path.read_bytes()
    package, _, name = ("tzdata.zoneinfo/" + zone).replace("/", ".").rpartition(".")
    return importlib.resources.files(package).joinpath(name).read_bytes()


def _rule_day(rule: str, year: int) -> int:
    """Seconds from the epoch to the local time that a rule such as ``M3.5.0/2`` names in a year."""
    day, _, clock = rule.partition("/")
    if day[0] == "M":
        month, week, weekday = map(int, day[1:].split("."))
        first = date(year, month, 1)
        days = first.toordinal() + (weekday - first.isoweekday()) % 7 + 7 * (week - 1)
        after = date(year + month // 12, month % 12 + 1, 1).toordinal()
        days -= 7 * (days >= after)
    else:
        number = int(day.lstrip("J"))
        days = date(year, 1, 1).toordinal() + number
        if day[0] == "J":  # counted without leap days
            days += (number >= 60 and date(year, 12, 31).timetuple().tm_yday == 366) - 1
    return (days - date(1970, 1, 1).toordinal()) * 86400 + _clock_seconds(clock or "2")


def _clock_seconds(text: str) -> int:
    parts = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    return (-1 if text.startswith("-") else 1) * (parts[0] * 3600 + parts[1] * 60 + parts[2])


_FOOTER = re.compile(r"(<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)(?:(<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)?,([^,]+),([^,]+))?")


@cache
def offset_intervals(zone: str) -> list[tuple[int, int, int, str]]:
    """(UTC start, UTC end, offset, abbreviation) in seconds up to ``LAST_YEAR``; the first and last are open."""
    data = _zone_file(zone)

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = counts(at)
    at += 44
    moments = struct.unpack(f">{times}q", data[at : at + 8 * times])
    kinds = data[at + 8 * times : at + 9 * times]
    at += 9 * times
    infos = [struct.unpack(">lBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    names = data[at + 6 * types : at + 6 * types + chars]
    footer = data[at + 6 * types + chars + 12 * leap + std + utc :].decode().strip()
    state = [(offset, names[i : names.index(0, i)].decode()) for offset, _, i in infos]
    changes = [(m, *state[k]) for m, k in zip(moments, kinds)]
    if m := _FOOTER.fullmatch(footer):
        name, offset, summer, summer_offset, start, stop = m.groups()
        standard = -_clock_seconds(offset)
        if summer:
            ahead = -_clock_seconds(summer_offset) if summer_offset else standard + 3600
            last = changes[-1][0] if changes else -_FAR
            year = max(1970, datetime.fromtimestamp(last, timezone.utc).year) if changes else 1970
            ruled = [x for y in range(year, LAST_YEAR + 2) for x in ((_rule_day(start, y) - standard, ahead, summer.strip("<>")), (_rule_day(stop, y) - ahead, standard, name.strip("<>")))]
            changes += sorted(x for x in ruled if x[0] > last)
    out, start_at, now = [], -_FAR, state[0]
    for moment, *then in changes:
        if tuple(then) != now:
            out.append((start_at, moment, *now))
            start_at, now = moment, tuple(then)
    return [*out, (start_at, _FAR, *now)]


def zone_table(spark: SparkSession, zones: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Exploded intervals (zone, year, spans) in local seconds, (zone, abbr, abbr_offset), and the first year. Names that are no zone are left out."""
    known = {}
    for zone in sorted(set(zones)):
        try:
            known[zone] = offset_intervals(zone)
        except (KeyError, ValueError, OSError):
            continue
    begins = [x[0][1] for x in known.values() if len(x) > 1]
    first_year = (datetime(1970, 1, 1) + timedelta(seconds=min(begins))).year - 1 if begins else LAST_YEAR - CYCLE
    year_start = {y: (date(y, 1, 1) - date(1970, 1, 1)).days * 86400 for y in range(first_year, LAST_YEAR + 2)}
    spans, abbrs = [], []
    for zone, intervals in known.items():
        latest = {abbr.lower(): offset for _, _, offset, abbr in intervals if abbr[:1].isalpha()}
        abbrs += [(zone, abbr, offset) for abbr, offset in latest.items()]
        local = [(s + o if s > -_FAR else s, e + o if e < _FAR else e, o) for s, e, o, _ in intervals]
        for year in range(first_year, LAST_YEAR + 1):
            a = -_FAR if year == first_year else year_start[year]
            b = _FAR if year == LAST_YEAR else year_start[year + 1]
            spans.append((zone, year, [x for x in local if x[0] < b and x[1] > a]))
    a = spark.createDataFrame(spans, "zone STRING, year INT, spans ARRAY<STRUCT<lo: BIGINT, hi: BIGINT, off: INT>>")
    return a, spark.createDataFrame(abbrs, "zone STRING, abbr STRING, abbr_offset INT"), first_year


def calendar_year(year: Column) -> Column:
    """A year up to ``LAST_YEAR`` that has the calendar of ``year``: itself, or one of the last ``CYCLE``."""
    alike = {(date(y, 1, 1).isoweekday() % 7 + 1) * 2 + (y % 4 == 0): y for y in range(LAST_YEAR - CYCLE + 1, LAST_YEAR + 1)}
    table = F.create_map(*[F.lit(x) for kv in alike.items() for x in kv])
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    kind = F.dayofweek(F.make_date(year, F.lit(1), F.lit(1))) * 2 + leap.cast("int")
    return F.when(year > LAST_YEAR, F.try_element_at(table, kind)).otherwise(year)


# Where a part of a text stands: rewritten to year|month|day|hour|minute|second|fraction|half|zone, the month still a word where it is one.
_CLOCK = r"(?:,? ?(?:t|at|à|às|um|o|в)? ?(\d{1,2})[:h時](\d{2})分?(?::(\d{2})(?:[.,](\d+))?)?(?: ?(am|pm)\b)?(?: ?(?:uhr|h)\b)?)?"
_ZONE = r" ?\(?((?:z|utc|gmt|ut)? ?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?\)?(?: \([^)]*\))?$"
_SHAPES = (
    (r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})年 ?(\d{1,2})月 ?(\d{1,2})日(?:\([^)]*\))?" + _CLOCK + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^\p{L}{2,14}\.?,? (\p{L}{3,12}) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?: ([a-z]{1,5}|[+-]\d{4}))? (\d{4})$", "$7|$1|$2|$3|$4|$5|||$6"),
    (r"^(?:\p{L}{2,14}\.?,? )?(\d{1,2})(?:\.|st|nd|rd|th|er|º)?[ -](?:de |of )?(\p{L}{3,12})\.?,?[ -](?:de |del )?(\d{4}|\d{2})(?: ?(?:г|r)\.)?" + _CLOCK + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^(?:\p{L}{2,14}\.?,? )?(\p{L}{3,12})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _CLOCK + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
_NUMERIC = r"^(\d{1,2})([./-])(\d{1,2})[./-](\d{4}|\d{2})" + _CLOCK + _ZONE
_DMY, _MDY, _YMD = "$4|$3|$1|$5|$6|$7|$8|$9|$10", "$4|$1|$3|$5|$6|$7|$8|$9|$10", "20$1|$3|$4|$5|$6|$7|$8|$9|$10"


def parsed(raw: Column, locale: Column) -> Column:
    """Array of the nine parts of a text, lower-cased; of one part for a number, null when it has no known shape."""
    s = F.lower(F.trim(F.regexp_replace(raw, "[\\s\u00a0\u2000-\u200f\u202f\u3000\ufeff]+", " ")))
    s = F.regexp_replace(F.regexp_replace(s, r"\ba\. ?m\.?(?!\w)", "am"), r"\bp\. ?m\.?(?!\w)", "pm")
    for pattern, to in _SHAPES:
        s = F.regexp_replace(s, pattern, to)
    place = F.lower(F.coalesce(locale, F.lit("")))
    # the dotted order is day first everywhere
    order = F.when(place.rlike("^en[-_]us") , F.lit(_MDY)).when(place.rlike("^(ja|zh|ko)"), F.lit(_YMD)).otherwise(F.lit(_DMY))
    s = F.regexp_replace(s, _NUMERIC.replace("[./-]", "[.]"), _DMY)
    s = F.regexp_replace(s, F.lit(_NUMERIC), order)
    return F.when(s.contains("|") | s.rlike(r"^-?\d{9,10}(\.\d+)?$|^\d{13}$|^\d{16}$|^\d{19}$"), F.split(s, r"\|"))


def instants(df: DataFrame, text: str, locale: str, zone: str, zones: list[str]) -> DataFrame:
    """``df`` with ``instant`` (``YYYY-MM-DDTHH:MM:SS.mmmZ``) and ``verdict`` of the text column.

    ``verdict``: ``number``, ``offset``, ``single``, ``ambiguous`` (earlier instant taken), ``nonexistent`` (no instant), ``unknown zone`` or
    ``none`` (null, empty or no possible date; no instant). Other columns, also ones of clashing names, are kept; no row is dropped.
    """
    spark = df.sparkSession
    spans, abbrs, first_year = zone_table(spark, zones)
    months = F.create_map(*[F.lit(x) for kv in month_words().items() for x in kv])
    language = F.lower(F.substring(F.coalesce(F.col(locale), F.lit("en")), 1, 2))
    out = df.withColumn("__w_a", parsed(F.col(text), F.col(locale)))
    a = F.col("__w_a")

    def number(i: int) -> Column:
        part = F.try_element_at(a, F.lit(i + 1))
        return F.when(part.rlike(r"^\d{1,4}$"), part.cast("int"))

    whole, part = F.regexp_extract(a[0], r"^(-?\d+)", 1), F.regexp_extract(a[0], r"\.(\d+)$", 1)
    sign = F.when(whole.startswith("-"), -1).otherwise(1)
    epoch = F.when(F.length(whole) <= 11, whole.cast("bigint") * 1000 + sign * F.rpad(F.substring(part, 1, 3), 3, "0").cast("bigint")).otherwise(F.substring(whole, 1, 13).cast("bigint"))
    word = F.try_element_at(a, F.lit(2))
    month = F.coalesce(number(1), F.try_element_at(months, F.concat(language, F.lit("|"), word)), F.try_element_at(months, F.concat(F.lit("en|"), word)))
    year = F.when(F.length(a[0]) == 2, number(0) + 2000).otherwise(number(0))
    out = out.withColumn("__w_p", F.when(F.size(a) == 9, F.struct(year.alias("y"), month.alias("m"), number(2).alias("d"), number(3).alias("h"), number(4).alias("mi"), number(5).alias("s"), F.try_element_at(a, F.lit(7)).alias("frac"), F.try_element_at(a, F.lit(8)).alias("half"), F.trim(F.try_element_at(a, F.lit(9))).alias("zone_text"))))
    out = out.withColumn("__w_epoch", F.when(F.size(a) == 1, epoch))
    p = F.col("__w_p")
    y, m, d, h, mi, sec, half = (p[x] for x in ("y", "m", "d", "h", "mi", "s", "half"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)
    hour = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(F.coalesce(h, F.lit(0)))
    fits = y.between(1000, 9999) & m.between(1, 12) & (d >= 1) & (d <= days) & (hour <= 23) & (F.coalesce(mi, F.lit(0)) <= 59) & (F.coalesce(sec, F.lit(0)) <= 60) & ((half == "") | h.between(1, 12))
    wall = F.when(fits, F.unix_date(F.make_date(y, m, d)).cast("bigint") * 86400 + hour * 3600 + F.coalesce(mi, F.lit(0)) * 60 + F.coalesce(sec, F.lit(0)))
    ms = F.rpad(F.substring(p["frac"], 1, 3), 3, "0").cast("bigint")
    z = F.regexp_replace(p["zone_text"], r"^(?:utc|gmt|ut|z) ?(?=[+-])", "")
    digits = F.regexp_replace(z, r"\D", "")
    # +2, +02, +0200: all but the last two of more than two digits are hours
    hh = F.regexp_replace(digits, r"^(\d{1,2})\d\d$", "$1")
    mm = F.when(F.length(digits) > 2, F.substring(digits, -2, 2)).otherwise("0")
    given = (
        F.when(z.rlike(r"^[+-]\d"), F.when(z.startswith("-"), -1).otherwise(1) * (F.when(hh != "", hh).cast("int") * 3600 + mm.cast("int") * 60))
        .when(z.isin("z", "utc", "gmt", "ut"), 0)
    )
    out = out.withColumns({"__w_wall": wall, "__w_ms": F.when(p.isNotNull(), F.coalesce(ms, F.lit(0))), "__w_given": given, "__w_abbr": F.when(z.rlike("^[a-z]") & ~z.isin("z", "utc", "gmt", "ut"), z), "__w_year": F.greatest(calendar_year(y), F.lit(first_year))})
    spans = spans.select(F.col("zone").alias("__w_zone"), F.col("year").alias("__w_at"), F.col("spans").alias("__w_spans"))
    abbrs = abbrs.select(F.col("zone").alias("__w_zone2"), F.col("abbr").alias("__w_abbr2"), F.col("abbr_offset").alias("__w_off2"))
    # bounded by the number of zones there are
    spans, abbrs = F.broadcast(spans), F.broadcast(abbrs)
    out = out.join(spans, (F.col(zone) == F.col("__w_zone")) & (F.col("__w_year") == F.col("__w_at")), "left")
    out = out.join(abbrs, (F.col(zone) == F.col("__w_zone2")) & (F.col("__w_abbr") == F.col("__w_abbr2")), "left")
    w = F.col("__w_wall")
    in_table = F.when(y > LAST_YEAR, w - (F.unix_date(F.make_date(y, F.lit(1), F.lit(1))) - F.unix_date(F.make_date("__w_year", F.lit(1), F.lit(1)))).cast("bigint") * 86400).otherwise(w)
    out = out.withColumn("__w_in_table", in_table)
    held = F.filter("__w_spans", lambda x: (x["lo"] <= F.col("__w_in_table")) & (x["hi"] > F.col("__w_in_table")))
    out = out.withColumn("__w_held", held)
    count = F.size("__w_held")
    epoch = F.col("__w_epoch")
    fixed = F.coalesce("__w_given", "__w_off2")
    verdict = (
        F.when(epoch.isNotNull(), "number")
        .when(w.isNull(), "none")
        .when(fixed.isNotNull(), "offset")
        .when(F.col("__w_abbr").isNotNull() | F.col("__w_spans").isNull(), "unknown zone")
        .when(count == 0, "nonexistent")
        .when(count > 1, "ambiguous")
        .otherwise("single")
    )
    # the earlier of two instants is the one of the larger offset
    offset = F.coalesce(fixed, F.when(F.col("__w_abbr").isNull(), F.array_max(F.transform("__w_held", lambda x: x["off"]))))
    millis = F.coalesce(epoch, (w - offset) * 1000 + F.col("__w_ms"))
    second, left = F.expr("0") + F.floor(millis / F.lit(1000)), F.pmod(millis, F.lit(1000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / F.lit(86400)).cast("int"))
    rest = F.pmod(second, F.lit(86400)).cast("int")
    text_of = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.format_string("%02d:%02d:%02d.%03dZ", F.floor(rest / F.lit(3600)).cast("int"), F.floor(F.pmod(rest, F.lit(3600)) / F.lit(60)).cast("int"), F.pmod(rest, F.lit(60)), left.cast("int")))
    return out.withColumns({"verdict": verdict, "instant": F.when(millis.isNotNull(), text_of)}).drop(*[c for c in out.columns if c.startswith("__w_")])


def zone_names(sites: DataFrame) -> list[str]:
    """Distinct zone names of the sites, of the about 600 that there are."""
    return [r[0] for r in sites.select("time_zone").where(F.col("time_zone").isin(sorted(zoneinfo.available_timezones()))).distinct().collect()]


def publication_and_fetch_instants(versions: DataFrame, sites: DataFrame, collector_zone: str = "Europe/Berlin") -> DataFrame:
    """One row per (doc_id, version, field) with its text, verdict and instant, over all rows.

    ``published_at`` is wall time of the site where it has no zone, ``fetched_at`` of the collector. Texts that are null, empty, no date or an
    impossible one, skipped by the clock, or without zone on an unknown site have no instant. Repeated rows give one row.
    """
    from weftline.functions.urls import site_of

    spark = versions.sparkSession
    one = versions.select("doc_id", "version", site_of(F.col("final_url")).alias("host"), F.col("meta.publishedAt").alias("published"), "fetched_at")
    site = sites.where("host IS NOT NULL").groupBy(F.lower("host").alias("site_host")).agg(F.min("locale").alias("site_locale"), F.min("time_zone").alias("site_zone"))
    one = one.join(site, F.col("host") == F.col("site_host"), "left")
    both = F.array(
        F.struct(F.lit("published_at").alias("field"), F.col("published").alias("text"), F.col("site_locale").alias("locale"), F.col("site_zone").alias("zone")),
        F.struct(F.lit("fetched_at").alias("field"), F.col("fetched_at").alias("text"), F.lit("de-DE").alias("locale"), F.lit(collector_zone).alias("zone")),
    )
    rows = one.select("doc_id", "version", F.explode(both).alias("v")).select("doc_id", "version", "v.*")
    done = instants(rows, "text", "locale", "zone", [*zone_names(sites), collector_zone])
    return done.select("doc_id", "version", "field", "text", "verdict", "instant").distinct()


def found(versions: DataFrame, sites: DataFrame) -> DataFrame:
    """Values that name an instant but are not already written in exactly the one form."""
    rows = publication_and_fetch_instants(versions, sites)
    return rows.where(F.col("instant").isNotNull() & ~((F.col("text") == F.col("instant")) & F.col("text").rlike(EXACT))).select("doc_id", "version", "field", "instant").distinct()
