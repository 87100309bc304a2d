"""Dates in announcement text, delivery times and retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

#: A date with its year, one that may inherit its year, and their parts.
TOKEN = r"20\d{2}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?(?:\s*\d{1,2}\s*(?::|：|时)\s*\d{0,2}\s*分?)?"
SHORT_TOKEN = r"(?:(?:20\d{2})\s*[年./-]\s*)?\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?(?:\s*\d{1,2}\s*(?::|：|时)\s*\d{0,2}\s*分?)?"
DATE = r"(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?(?:\s*(\d{1,2})\s*(?::|：|时)\s*(\d{0,2})\s*分?)?"
SHORT = r"(?:(20\d{2})\s*[年./-]\s*)?(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?(?:\s*(\d{1,2})\s*(?::|：|时)\s*(\d{0,2})\s*分?)?"
BETWEEN = r"\s*(?:至|到|—|–|~|～)\s*"

#: What introduces the dates of registration and of the competition.
REGISTRATION_RANGE = rf"(?:报名|注册)(?:开始)?(?:时间)?\s*[：:]?\s*({TOKEN})\s*(?:至|到|—|–|~|～)\s*({SHORT_TOKEN})"
REGISTRATION_START = rf"(?:报名|注册)(?:开始|开放)(?:时间)?\s*[：:]?\s*({TOKEN})"
REGISTRATION_END = rf"(?:报名|注册)(?:截止|结束)(?:时间)?\s*[：:]?\s*({TOKEN})"
LOOSE_END = rf"(?:报名|注册)[^。；;\n]{{0,80}}?(?:截止(?:时间)?(?:为|至|到|于)?|结束(?:时间)?(?:为|至|到|于)?|即日起(?:至|到))\s*[：:]?\s*({TOKEN})"
COMPETITION_RANGE = rf"(?:比赛|竞赛|赛事)(?:时间|赛程)\s*[:：]?\s*({TOKEN})\s*(?:至|到|—|-|~|～)\s*({SHORT_TOKEN})"
COMPETITION_START = rf"(?:开赛|比赛开始|竞赛开始|赛事开始)(?:时间)?\s*[:：]?\s*({TOKEN})"
COMPETITION_END = rf"(?:比赛|竞赛|赛事)(?:结束|截止)(?:时间)?\s*[:：]?\s*({TOKEN})"
DAY_RANGE = (
    r"(?:(?:比赛|竞赛|赛事)(?:时间|赛程)?\s*[:：]?\s*|(?:将于|计划于|定于)[^。！？；;\n]{0,40}?)"
    rf"({TOKEN})\s*(?:至|到|—|–|-|~|～)\s*(\d{{1,2}})\s*日?"
    r"(?:\s*(\d{1,2})\s*[：:时]\s*\d{0,2}\s*分?)?"
    r"(?:[^。！？；;\n]{0,40}?(?:举行|举办|开幕|开赛|召开|开始|进行))?"
)
DAY_RANGE_NOT = ["报名", "注册", "缴费", "交费", "报名费", "参赛缴费", "材料提交", "材料上传", "材料递交"]
DAY_RANGE_ABOUT = ["比赛时间", "竞赛时间", "赛事时间", "赛程", "举行", "举办", "开幕", "开赛", "召开", "总决赛", "决赛"]
CLAUSE_ENDS = "[。！？!?；;\n]"

BACKOFF_FIRST, BACKOFF_MOST = 300, 86_400


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """The groups of the first match as one array; null where there's none."""
    listed = ",".join(f"${k}" for k in range(1, groups + 1))
    return let(F.regexp_extract(text, pattern, 0), lambda w: F.when(w != "", F.split(F.regexp_replace(w, pattern, listed), ",")))


def _number(parts: Column, at: int) -> Column:
    """A group as a number; null, without a failed cast (which is an exception inside), where it's empty."""
    return F.nullif(F.get(parts, F.lit(at)), F.lit("")).try_cast("int")


def _made(parts: Column, year: Column, base: int = 0) -> Column:
    part = lambda k: _number(parts, base + k)
    hour, minute = F.coalesce(part(3), F.lit(0)), F.coalesce(part(4), F.lit(0))
    midnight = (hour == 24) & (minute == 0)
    h, m = F.when(midnight, 23).otherwise(hour), F.when(midnight, 59).otherwise(minute)
    return F.try_make_timestamp(years=year, months=part(1), days=part(2), hours=h, mins=m, secs=F.lit(0))


def parse_date(text: Column) -> Column:
    """The first explicit-year date as a timestamp; null where there's none or it isn't valid."""
    return let(_parts(text, DATE, 5), lambda p: _made(p, _number(p, 0)))


def date_range(text: Column) -> Column:
    """Struct (start, end): both or neither; the end takes the start's year if it has none."""

    def read(p: Column) -> Column:
        start = _made(p, _number(p, 0))
        return let(F.struct(start.alias("start"), _made(p, F.coalesce(_number(p, 5), F.year(start)), 5).alias("end")), ordered)

    def ordered(r: Column) -> Column:
        valid = r["start"].isNotNull() & r["end"].isNotNull() & (r["end"] >= r["start"])
        return F.struct(F.when(valid, r["start"]).alias("start"), F.when(valid, r["end"]).alias("end"))

    return let(_parts(text, DATE + BETWEEN + SHORT, 10), read)


def day_start(ts: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def backoff_seconds(attempts: Column) -> Column:
    """min(a day, 300 * 2 ** min(attempts, 8)), with the attempts before this one."""
    return F.least(F.lit(BACKOFF_MOST), F.lit(BACKOFF_FIRST) * F.pow(F.lit(2), F.least(attempts, F.lit(8))).cast("int"))


def next_delivery(now: Column, frequency: Column, hour: Column, minute: Column, weekday: Column, zone: Column) -> Column:
    """When the next delivery is due; ``weekday`` 0 is Sunday, wall times are in ``zone``."""
    local = F.from_utc_timestamp(now, zone)
    at = F.date_trunc("day", local) + F.make_interval(hours=hour, mins=minute)
    daily = F.when(at > local, at).otherwise(at + F.expr("INTERVAL 1 DAY"))
    ahead = F.pmod(weekday - (F.dayofweek(local) - 1), F.lit(7))
    day = at + F.make_interval(days=ahead)
    weekly = F.when(day > local, day).otherwise(day + F.expr("INTERVAL 7 DAYS"))
    wall = F.when(frequency == "daily", daily).when(frequency == "weekly", weekly)
    return F.when(frequency == "immediate", now).otherwise(F.to_utc_timestamp(wall, zone))


def next_retry(status: Column, now: Column, retry_hours: int = 6, unresolved_hours: int = 72) -> Column:
    return F.when(status == "retryable", now + F.make_interval(hours=F.lit(retry_hours))).when(status == "unresolved", now + F.make_interval(hours=F.lit(unresolved_hours)))


def _span(start: Column, start_raw: Column, end: Column, end_raw: Column) -> Column:
    return F.struct(start.alias("start"), start_raw.alias("start_raw"), end.alias("end"), end_raw.alias("end_raw"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _dated(text: Column, between: str, first: str, last: str) -> Column:
    """Struct (start, start_raw, end, end_raw): a range if one is written, else the dates apart.

    The end of a range may inherit its year; a range that isn't valid gives no dates.
    """
    nothing = _span(*(F.lit(None).cast(t) for t in ("timestamp", "string", "timestamp", "string")))

    def ranged(whole: Column) -> Column:
        left, right = F.regexp_extract(whole, between, 1), F.regexp_extract(whole, between, 2)
        later = lambda e: let(_parts(e["right"], SHORT, 5), lambda p: _made(p, F.coalesce(_number(p, 0), F.year(e["start"]))))
        ended = lambda e: let(F.coalesce(parse_date(e["right"]), later(e)), lambda end: F.when(end >= e["start"], _span(e["start"], _trim(e["left"]), end, _trim(e["right"]))).otherwise(nothing))
        return let(F.struct(parse_date(left).alias("start"), left.alias("left"), right.alias("right")), ended)

    def apart(t: Column) -> Column:
        raw = F.struct(F.regexp_extract(t, first, 1).alias("first"), F.regexp_extract(t, last, 1).alias("last"))
        alone = lambda c: (parse_date(c), F.nullif(_trim(c), F.lit("")))
        return let(raw, lambda r: _span(*alone(r["first"]), *alone(r["last"])))

    return let(F.regexp_extract(text, between, 0), lambda whole: F.when(whole != "", ranged(whole)).otherwise(apart(text)))


def registration_dates(text: Column) -> Column:
    """Struct (start, start_raw, end, end_raw) of the registration.

    One loose deadline replaces the end, several different ones clear it.
    """
    hinted = lambda h: F.struct(parse_date(h).alias("at"), _trim(h).alias("raw"))

    def settled(both: Column) -> Column:
        span, ends = both["span"], both["ends"]
        n = F.size(F.array_distinct(F.transform(ends, lambda h: h["at"])))
        return let(n, lambda n: _span(span["start"], span["start_raw"], F.when(n == 1, ends[0]["at"]).when(n == 0, span["end"]), F.when(n == 1, ends[0]["raw"]).when(n == 0, span["end_raw"])))

    def read(t: Column) -> Column:
        strict = _dated(t, REGISTRATION_RANGE, REGISTRATION_START, REGISTRATION_END)
        hints = F.transform(F.regexp_extract_all(t, F.lit(LOOSE_END), F.lit(1)), hinted)
        return let(F.struct(strict.alias("span"), F.filter(hints, lambda h: h["at"].isNotNull()).alias("ends")), settled)

    return let(text, read)


def registration_deadlines(text: Column) -> Column:
    """All deadlines that a text hints at."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(LOOSE_END), F.lit(1)), parse_date), lambda d: d.isNotNull()))


def day_range(text: Column) -> Column:
    """The first range whose end is only a day of the start's month, in a clause on the competition itself.

    An end with a time of its own, before the start or not in the calendar is passed over.
    """
    about = F.filter(F.split(text, CLAUSE_ENDS), lambda c: c.rlike("|".join(DAY_RANGE_ABOUT)) & ~c.rlike("|".join(DAY_RANGE_NOT)))
    matches = F.flatten(F.transform(about, lambda c: F.regexp_extract_all(c, F.lit(DAY_RANGE), F.lit(0))))

    def read(whole: Column) -> Column:
        left, day, time = (F.regexp_extract(whole, DAY_RANGE, k) for k in (1, 2, 3))
        ended = lambda s: F.try_make_timestamp(years=F.year(s["at"]), months=F.month(s["at"]), days=F.nullif(s["day"], F.lit("")).try_cast("int"), hours=F.lit(0), mins=F.lit(0), secs=F.lit(0))
        spanned = lambda s: let(ended(s), lambda end: F.when((s["time"] == "") & (end >= s["at"]), _span(s["at"], _trim(s["left"]), end, s["day"])))
        return let(F.struct(parse_date(left).alias("at"), left.alias("left"), day.alias("day"), time.alias("time")), spanned)

    return F.try_element_at(F.filter(F.transform(matches, read), lambda s: s.isNotNull()), F.lit(1))


def competition_dates(text: Column) -> Column:
    """Struct (start, start_raw, end, end_raw) of the competition; a day range where no whole one is written."""
    whole = lambda s: s["start"].isNotNull() & s["end"].isNotNull()
    strict = lambda t: _dated(t, COMPETITION_RANGE, COMPETITION_START, COMPETITION_END)
    return let(text, lambda t: let(strict(t), lambda s: F.when(whole(s), s).otherwise(F.coalesce(day_range(t), s))))


def only_day_range(start: Column, end: Column, start_raw: Column, end_raw: Column) -> Column:
    """Whether dates are those of a day range: one month, an end written as a day alone."""
    bare = r"^\s*\d{1,2}\s*日?\s*$"
    same = (F.year(start) == F.year(end)) & (F.month(start) == F.month(end))
    return F.coalesce(same & (end >= start) & ~start_raw.rlike(bare) & end_raw.rlike(bare), F.lit(False))
