"""Text to typed values, and identifiers built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeaxis.schema import BAR_VALUES, PRICE

# Identifier prefixes, suffixes and the closing time used when none can be read.
ASSET_PREFIX = "EQ_AST_"
SERIES_PREFIX = "EQ_PRS_"
INDEX_WEIGHT_PREFIX = "IDX_WEIGHT_"
CURVE_PREFIX = "CBR_ZCYC_"
CONTRACT_SUFFIX = "_F"
DEFAULT_CLOSE = (19, 30)
EXCHANGE_ZONE = "Europe/Moscow"

# White space at the ends of a text, as the sources' own readers strip it.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Shapes of dates, contract names and the cut-off time.
ISO_DATE, BASIC_DATE, DOTTED_DATE = r"^\d{4}-\d{2}-\d{2}$", r"^\d{8}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$"
ISO_IN_TEXT, DOTTED_IN_TEXT = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})\.(\d{2})\.(\d{4})"
WORDED_IN_TEXT = r"(\d{1,2})\s+([А-Яа-яЁё]+)\s+(\d{4})"
CONTRACT_NAME = r"^BR-(\d{1,2})\.(\d{2})$"
CUT_OFF = r"\s*(\d{1,2})\s*:\s*(\d{1,2})\s*"

# Genitive month names as they appear in page captions.
RUSSIAN_MONTHS = {
    "января": 1,
    "февраля": 2,
    "марта": 3,
    "апреля": 4,
    "мая": 5,
    "июня": 6,
    "июля": 7,
    "августа": 8,
    "сентября": 9,
    "октября": 10,
    "ноября": 11,
    "декабря": 12,
}


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _stripped(c: Column | str) -> Column:
    return F.trim(_text(c), F.lit(WHITE))


def decimal_or_null(c: Column | str) -> Column:
    """Exact decimal, or NULL for a missing, empty or unreadable text; never zero.

    The cast drops the white space of plain characters itself, so only other texts are stripped before; one without a
    digit is not tried, as a failed cast costs more than all else here.
    """
    text = _text(c)
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.when(text.rlike("[0-9]"), text.try_cast(PRICE))).otherwise(_stripped(text).try_cast(PRICE))


def local_number(c: Column | str, minus: bool = False) -> Column:
    """Russian number format: spaces dropped, decimal comma; with ``minus`` also the typographic sign."""
    if minus:
        return F.translate(_text(c), ",\u2212\u00a0 ", ".-")
    return F.translate(_text(c), ",\u00a0 ", ".")


def local_decimal(c: Column | str, minus: bool = False) -> Column:
    return decimal_or_null(local_number(c, minus))


def iso_date(c: Column | str) -> Column:
    """The date in the first ten characters, or NULL."""
    head = F.substring(_stripped(c), 1, 10)
    return F.when(head.rlike(ISO_DATE), F.try_to_date(head, "yyyy-MM-dd")).when(
        head.rlike(BASIC_DATE), F.try_to_date(head, "yyyyMMdd")
    )


def dotted_date(c: Column | str) -> Column:
    text = _text(c)
    return F.when(text.rlike(DOTTED_DATE), F.try_to_date(text, "d.M.yyyy"))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def date_in_text(c: Column | str) -> Column:
    """A date anywhere in a caption: ISO, dotted, or a day with a Russian month name."""
    text = _text(c)
    iso, dotted, worded = ISO_IN_TEXT, DOTTED_IN_TEXT, WORDED_IN_TEXT

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    month_of = F.create_map(
        *[F.lit(x) for name, n in RUSSIAN_MONTHS.items() for x in (name, str(n))]
    )
    month = F.try_element_at(month_of, F.lower(part(worded, 2)))
    return (
        F.when(text.rlike(iso), _ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(text.rlike(dotted), _ymd(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(month.isNotNull(), _ymd(part(worded, 3), month, part(worded, 1)))
    )


def ticker(c: Column | str) -> Column:
    """Trimmed upper-case ticker; a blank one is NULL so that the row can be filtered out."""
    return F.nullif(F.upper(_stripped(c)), F.lit(""))


def asset_id(c: Column | str) -> Column:
    return F.concat(F.lit(ASSET_PREFIX), ticker(c))


def price_series_id(c: Column | str) -> Column:
    return F.concat(F.lit(SERIES_PREFIX), ticker(c))


def index_weight_series_id(index_id: Column | str, c: Column | str) -> Column:
    return F.concat(F.lit(INDEX_WEIGHT_PREFIX), _text(index_id), F.lit("_"), ticker(c))


def curve_series_id(term: Column | str) -> Column:
    return F.concat(F.lit(CURVE_PREFIX), _text(term))


def fingerprint(columns: tuple[str, ...] = BAR_VALUES) -> Column:
    """Hash of the values, telling NULL from zero. Hashes the stored scale, so ``1.5`` is ``1.50``."""
    parts = [F.coalesce(F.col(name).cast(PRICE).cast("string"), F.lit("")) for name in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def contract_expiry(c: Column | str) -> Column:
    """Last day of the delivery month of a short name such as ``BR-9.26``."""
    text = _stripped(c)
    month = F.regexp_extract(text, CONTRACT_NAME, 1).try_cast("int")
    year = F.regexp_extract(text, CONTRACT_NAME, 2).try_cast("int")
    first = F.when(month.between(1, 12), F.make_date(F.lit(2000) + year, month, F.lit(1)))
    return F.last_day(first)


def units_nano(units: Column | str, nano: Column | str) -> Column:
    """Whole units plus billionths; NULL only when both are missing."""
    u = F.col(units) if isinstance(units, str) else units
    n = F.col(nano) if isinstance(nano, str) else nano
    whole = F.coalesce(u.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    billionths = F.coalesce(n.cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)"))
    part = (billionths * F.lit("0.000000001").cast("decimal(9,9)")).cast(PRICE)
    return F.when(u.isNotNull() | n.isNotNull(), (whole.cast(PRICE) + part).cast(PRICE))


def closing_time(raw: str) -> tuple[int, int]:
    """Hours and minutes of the cut-off; an unreadable setting falls back to the default."""
    found = re.fullmatch(CUT_OFF, raw or "")
    if found and int(found[1]) < 24 and int(found[2]) < 60:
        return int(found[1]), int(found[2])
    return DEFAULT_CLOSE


def session_closed(session_date: Column | str, now_utc: Column, cutoff: str) -> Column:
    """Whether a session is over at ``now_utc``, judged by the exchange's own clock."""
    day = F.col(session_date) if isinstance(session_date, str) else session_date
    local = F.from_utc_timestamp(now_utc.cast("timestamp"), EXCHANGE_ZONE)
    hour, minute = closing_time(cutoff)
    after = F.date_format(local, "HH:mm") >= F.lit(f"{hour:02d}:{minute:02d}")
    today = F.to_date(local)
    return (day < today) | ((day == today) & after)
