"""Column expressions shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"

# Text patterns accepted for request fields.
USERNAME = "^[a-zA-Z0-9_а-яА-Я]+$"
INTEGER = "^[-+]?[0-9]+$"
FLOAT = "^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"
EMAIL = "^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?[.])+[A-Za-z]{2,63}$"
URL = (
    "^((https?|ftp)://)?([A-Za-z0-9]([A-Za-z0-9_-]{0,61}[A-Za-z0-9])?[.])+[A-Za-z]{2,63}"
    "(:[0-9]{1,5})?([/?#][^ ]*)?$"
)
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[-+][0-9]{2}:?[0-9]{2})?)?$"
BOOLEAN = ("true", "false", "1", "0")
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"

# Mail hosts whose addresses have a tag or several spellings.
GOOGLE_HOSTS = ("gmail.com", "googlemail.com")
ICLOUD_HOSTS = ("icloud.com", "me.com")
OUTLOOK_HOSTS = (
    "hotmail.at", "hotmail.be", "hotmail.ca", "hotmail.cl", "hotmail.co.il", "hotmail.co.nz", "hotmail.co.th", "hotmail.co.uk",
    "hotmail.com", "hotmail.com.ar", "hotmail.com.au", "hotmail.com.br", "hotmail.com.gr", "hotmail.com.mx", "hotmail.com.pe",
    "hotmail.com.tr", "hotmail.com.vn", "hotmail.cz", "hotmail.de", "hotmail.dk", "hotmail.es", "hotmail.fr", "hotmail.hu",
    "hotmail.id", "hotmail.ie", "hotmail.in", "hotmail.it", "hotmail.jp", "hotmail.kr", "hotmail.lv", "hotmail.my", "hotmail.ph",
    "hotmail.pt", "hotmail.sa", "hotmail.sg", "hotmail.sk", "live.be", "live.co.uk", "live.com", "live.com.ar", "live.com.mx",
    "live.de", "live.es", "live.eu", "live.fr", "live.it", "live.nl", "msn.com", "outlook.at", "outlook.be", "outlook.cl",
    "outlook.co.il", "outlook.co.nz", "outlook.co.th", "outlook.com", "outlook.com.ar", "outlook.com.au", "outlook.com.br",
    "outlook.com.gr", "outlook.com.pe", "outlook.com.tr", "outlook.com.vn", "outlook.cz", "outlook.de", "outlook.dk",
    "outlook.es", "outlook.fr", "outlook.hu", "outlook.id", "outlook.ie", "outlook.in", "outlook.it", "outlook.jp", "outlook.kr",
    "outlook.lv", "outlook.my", "outlook.ph", "outlook.pt", "outlook.sa", "outlook.sg", "outlook.sk", "passport.com",
)
YAHOO_HOSTS = (
    "rocketmail.com", "yahoo.ca", "yahoo.co.uk", "yahoo.com", "yahoo.de", "yahoo.fr", "yahoo.in", "yahoo.it", "ymail.com",
)
YANDEX_HOSTS = ("yandex.ru", "yandex.ua", "yandex.kz", "yandex.com", "yandex.by", "ya.ru")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yes_no(c: Column | str) -> Column:
    """'Yes' when true, 'No' when false or NULL."""
    return F.when(col(c), F.lit("Yes")).otherwise(F.lit("No"))


def active_label(c: Column | str) -> Column:
    return F.when(col(c), F.lit("Active")).otherwise(F.lit("Inactive"))


def is_integer(c: Column | str, low: int | None = None) -> Column:
    """Text that reads as a whole number of any length, optionally at least ``low``."""
    c = col(c)
    ok = c.rlike(INTEGER)
    return ok if low is None else ok & (c.try_cast("decimal(38,0)") >= low)


def is_number(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    c = col(c)
    value = c.try_cast("double")
    ok = c.rlike(FLOAT) & value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def is_date(c: Column | str) -> Column:
    """ISO date or date-time text that names an existing day."""
    c = col(c)
    return c.rlike(DATE) & F.substring(c, 1, 10).try_cast("date").isNotNull()


def is_boolean(c: Column | str) -> Column:
    return col(c).cast("string").isin(*BOOLEAN)


def is_email(c: Column | str) -> Column:
    c = col(c)
    return c.rlike(EMAIL) & ~c.contains("..") & ~c.startswith(".") & ~c.contains(".@")


def is_url(c: Column | str) -> Column:
    return col(c).rlike(URL)


def trimmed(c: Column | str) -> Column:
    """Text without white space at its ends."""
    return F.btrim(col(c), F.lit(" \t\r\n\f\u000b\u00a0\ufeff"))


def trimmed_length(c: Column | str) -> Column:
    """Length after trimming; NULL counts as empty."""
    return F.length(F.coalesce(trimmed(c), F.lit("")))


def is_uuid(c: Column | str) -> Column:
    return col(c).rlike(UUID)


def normalized_email(c: Column | str) -> Column:
    """Lower case; at the hosts listed above, and no others, one spelling for all addresses of a mailbox.

    Google, Outlook and iCloud addresses lose '+tag', Google ones dots, too; Yahoo addresses lose what follows the last
    '-'; Google and Yandex hosts get one name. An address that would be left without a name only becomes lower case.
    """
    lower = F.lower(trimmed(c))
    local, host = F.split_part(lower, F.lit("@"), F.lit(1)), F.split_part(lower, F.lit("@"), F.lit(-1))
    untagged = F.split_part(local, F.lit("+"), F.lit(1))
    name = (
        F.when(host.isin(*GOOGLE_HOSTS), F.replace(untagged, F.lit("."), F.lit("")))
        .when(host.isin(*ICLOUD_HOSTS, *OUTLOOK_HOSTS), untagged)
        .when(host.isin(*YAHOO_HOSTS), F.regexp_replace(local, "-[^-]*$", ""))
        .otherwise(local)
    )
    at = F.when(host.isin(*GOOGLE_HOSTS), F.lit("gmail.com")).when(host.isin(*YANDEX_HOSTS), F.lit("yandex.ru")).otherwise(host)
    return F.when(lower.contains("@") & (name != ""), F.concat(name, F.lit("@"), at)).otherwise(lower)


def period_start(period: str, as_of: dt.date | Column | None = None) -> Column:
    """First day of the month, quarter or year holding ``as_of``; any other word means year."""
    day = F.current_date() if as_of is None else (as_of if isinstance(as_of, Column) else F.lit(as_of))
    return F.trunc(day, period if period in ("month", "quarter") else "year")


def line_total(quantity: Column | str, unit_price: Column | str, kind: str = MONEY) -> Column:
    return (col(quantity) * col(unit_price)).cast(kind)


def vat_of(subtotal: Column | str, rate: Column | str, kind: str = MONEY) -> Column:
    """VAT of an exact subtotal, rounded half up to cents."""
    return F.round(col(subtotal) * col(rate) / F.lit(100), 2).cast(kind)


def total_with_vat(subtotal: Column | str, rate: Column | str, kind: str = MONEY) -> Column:
    """Rounded on its own, so it may differ by a cent from subtotal + rounded VAT."""
    exact = col(subtotal).cast("decimal(20,4)") + col(subtotal) * col(rate) / F.lit(100)
    return F.round(exact, 2).cast(kind)


def initial_stock(original: Column | str, reservation: Column | str) -> Column:
    """Opening balance: original less 5 % less the reservation, never below zero."""
    original, reservation = col(original), F.coalesce(col(reservation), F.lit(0).cast(MONEY))
    left = original - original * F.lit("0.05").cast("decimal(3,2)") - reservation
    return F.greatest(F.lit(0).cast("decimal(16,4)"), left.cast("decimal(16,4)")).cast(MONEY)


def iso_utc(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_stamp(now: dt.datetime) -> str:
    """How a moment is written into log details."""
    return now.isoformat(timespec="milliseconds") + "Z"


def clean_ip(c: Column | str) -> Column:
    """IPv6 loopback is written as its IPv4 form."""
    c = col(c)
    return F.when(c == "::1", F.lit("127.0.0.1")).otherwise(c)
