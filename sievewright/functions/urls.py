"""URL and time text as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.cells import strip
from sievewright.functions.patterns import ISO_DATE, ISO_TIME

ZONE = "Asia/Shanghai"
OUT = "yyyy-MM-dd HH:mm:ss"
# Field names read as times, and the endings of others.
TIME_NAMES = ("published_at", "created_at", "updated_at", "date", "time", "datetime", "timestamp")
TIME_ENDINGS = ("_at", "_date", "_time", "datetime", "timestamp")
TIME_MARKS = ("发布时间", "创建时间", "更新时间", "日期")


def clean_url(c: Column) -> Column:
    """The URL without its fragment."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "#.*$", "")


def host(c: Column) -> Column:
    """Lower-case host without port and leading www."""
    place = F.regexp_extract(F.coalesce(c, F.lit("")), r"\A[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(place), r":.*$", ""), r"\Awww\.", "")


def same_site(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_safe_url(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?i)\Ahttps?://[^/?#]+"), F.lit(False))


def local_time(c: Column) -> Column:
    """ISO, epoch seconds or milliseconds, eight digits or RFC 2822 as UTC+8 text; anything else unchanged.

    Times without a zone are taken as local already.
    """
    t = strip(c)
    number = F.when(t.rlike(r"\A(\d{10}(\.\d+)?|\d{13})\z"), t.cast("double"))
    moment = F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number))
    day = F.try_to_timestamp(F.when(t.rlike(r"\A\d{8}\z"), t), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    zoned = rf"\A{ISO_DATE}{ISO_TIME}([zZ]|[+-]\d{{2}}:?\d{{2}})\z"
    aware = F.when(t.rlike(zoned), F.regexp_replace(F.upper(t), r"([+-]\d{2})(\d{2})\z", "$1:$2")).try_cast("timestamp")
    naive = F.when(t.rlike(rf"\A{ISO_DATE}({ISO_TIME})?\z"), F.regexp_replace(t, r"([T ]\d{2})\z", "$1:00")).try_cast("timestamp_ntz")
    mail = F.when(t.rlike(r"\A([A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} ([+-]\d{4}|GMT)\z"), F.regexp_replace(F.regexp_replace(t, r"\A[A-Z][a-z]{2}, ", ""), "GMT", "+0000"))
    mailed = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))

    def shifted(ts: Column) -> Column:
        return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.to_utc_timestamp(ts, F.current_timezone()).cast("timestamp_ntz")), OUT)

    return F.coalesce(shifted(moment), F.date_format(day, OUT), shifted(aware), F.date_format(naive, OUT), shifted(mailed), c)


def time_columns(names: list[str]) -> list[str]:
    """Columns that look like times by their names."""
    return [n for n in names if n.lower() in TIME_NAMES or n.lower().endswith(TIME_ENDINGS) or any(m in n for m in TIME_MARKS)]


def normalise_times(df):
    return df.withColumns({n: local_time(F.col(n).cast("string")) for n in time_columns(df.columns)})


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def pointer_token(c: Column) -> Column:
    """One JSON pointer token: ~ and / escaped."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
