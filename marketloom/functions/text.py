"""Scalar column functions: text, numbers, dates, urls. All are built-in expressions except the two Arrow UDFs at the end."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def iso_week(c) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def half_up(c: Column, places: int = 2) -> Column:
    """Rounding that Spark and SQL agree on: floor(x * 10^places + 0.5) / 10^places."""
    m = 10**places
    return F.floor(c * m + 0.5) / F.lit(float(m))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def identity_text(c: Column) -> Column:
    """Squeezed text in upper case; only text with two blanks or other white space meets the pattern, which is dear by row."""
    odd = F.contains(c, F.lit("  "))
    for blank in "\t\n\x0b\f\r":
        odd = odd | F.contains(c, F.lit(blank))
    return F.upper(F.when(odd, squeeze(c)).otherwise(F.trim(F.coalesce(c, F.lit("")))))


def search_text(c: Column) -> Column:
    """Lower case without urls; only letters a-z, digits and % & + - stay."""
    no_url = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_url, r"[^a-z0-9%&+\- ]", " "), r"\s+", " "))


def name_tokens(c: Column) -> Column:
    cleaned = F.translate(F.lower(F.coalesce(c, F.lit(""))), "/,;|()-_.", "         ")
    return F.filter(F.split(F.trim(F.regexp_replace(cleaned, r"\s+", " ")), " "), lambda t: t != "")


def parse_price(c: Column) -> Column:
    """First number of a price text; commas group digits."""
    return F.regexp_replace(F.regexp_extract(c, r"[0-9][0-9,]*(?:[.][0-9]+)?", 0), ",", "").try_cast("double")


def currency_prices(c: Column, low: float, high: float) -> Column:
    """Distinct prices behind an explicit currency mark, in order, within bounds."""
    found = F.regexp_extract_all(c, F.lit(r"(?:KSh|KES|Kshs?)[.]? ?([0-9][0-9,]*(?:[.][0-9]+)?)"), F.lit(1))
    values = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_distinct(F.filter(values, lambda v: v.between(low, high)))


def parse_metric(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?[0-9]+", 0).try_cast("long")


def pct_change(previous: Column, current: Column) -> Column:
    return F.when(previous != 0, half_up((current - previous) / previous * 100))


def discount_pct(regular: Column, sale: Column) -> Column:
    return F.when((regular > 0) & (sale < regular), half_up((regular - sale) / regular * 100))


def parse_datetime(c: Column) -> Column:
    """ISO, RFC-2822 and the usual day-month forms; null if none fits.

    A form is tried on texts with the signs that it asks for and no others, since each failed trial throws."""
    forms = {  # signs of [-:,/ ] that must and that can't occur
        "yyyy-MM-dd'T'HH:mm:ssXXX": ("-:", ",/ "), "yyyy-MM-dd HH:mm:ss": ("-: ", ",/"), "yyyy-MM-dd": ("-", ":,/ "),
        "EEE, d MMM yyyy HH:mm:ss Z": (": ", ",/"), "d MMMM yyyy": (" ", ":,/"), "d MMM yyyy": (" ", ":,/"), "MMMM d, yyyy": (", ", ":/"),
        "dd/MM/yyyy": ("/", ":, "),
    }
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", "")
    tries = []
    for form, (has, lacks) in forms.items():
        said = F.trim(c) if "EEE" not in form else text
        fits = reduce(and_, [F.contains(said, F.lit(x)) for x in has] + [~F.contains(said, F.lit(x)) for x in lacks])
        tries.append(F.when(fits, F.try_to_timestamp(said, F.lit(form.removeprefix("EEE, ")))))
    return F.coalesce(*tries)


def relative_time(c: Column, reference: Column) -> Column:
    """`3 hours ago` and the like, counted back from a reference time."""
    n = F.regexp_extract(F.lower(c), r"([0-9]+) *(min|hour|day|week)", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(c), r"([0-9]+) *(min|hour|day|week)", 2)
    minutes = n * F.when(unit == "min", 1).when(unit == "hour", 60).when(unit == "day", 1440).when(unit == "week", 10080)
    return F.when(F.lower(c).contains("ago"), reference - F.make_dt_interval(mins=minutes))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default path /, query kept, fragment dropped."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*([?][^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query)


def url_identity(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.concat(F.regexp_replace(host_of(url), r"^www[.]", ""), F.regexp_replace(path, r"/+$", ""))


def redirect_target(url: Column) -> Column:
    """The url that a redirect link carries in its query (u or url), decoded; else the url."""
    inner = F.regexp_extract(url, r"[?&](?:u|url)=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(F.try_url_decode(inner))).otherwise(url)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def truncate_words(c: Column, n: int) -> Column:
    """The longest run of whole words within n characters."""
    head = F.substring(c, 1, n + 1)
    return F.when(F.length(c) > n, F.regexp_replace(head, r"\s*\S*$", "")).otherwise(c)


def around(c: Column, needle: Column, radius: int) -> Column:
    """Text round the first place of needle, radius characters on either side; empty if it is not there."""
    at = F.position(needle, c)
    first = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(c, first, at + F.length(needle) + radius - first)).otherwise("")


def period_label(start: Column, end: Column) -> Column:
    """`a to b`; one day alone, if both are equal or the other is missing; `date not recorded` without any."""
    s, e = (F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (start, end))
    return F.when(s != e, F.concat(s, F.lit(" to "), e)).otherwise(F.coalesce(s, e, F.lit("date not recorded")))


def hash_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 16)


def contains_any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def matching_terms(c: Column, terms) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms)))


def first_rule(rules, otherwise=None) -> Column:
    """Ordered (condition, value) rules: the first that holds wins."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def word(term: str) -> str:
    """Pattern of a whole word or phrase that Java and RE2 read alike."""
    return rf"(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)"


def any_word(terms: list[str]) -> str:
    """Pattern of any of some whole words or phrases; a boundary is looked at before the terms are tried."""
    return rf"(^|[^a-z0-9])(?:{'|'.join(map(re.escape, terms))})([^a-z0-9]|$)"


# ---------------------------------------------------------------- Arrow UDFs

#: Characters that wrong decoding leaves, and quotes folded to ASCII.
FOLDS = {"â€™": "'", "â€œ": '"', "â€\x9d": '"', "â€“": "-", "Ã©": "é", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " "}


def _clean(text: str | None) -> str:
    if not text:
        return ""
    text = html.unescape(text)
    for bad, good in FOLDS.items():
        text = text.replace(bad, good)
    text = unicodedata.normalize("NFKC", text)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def clean_article(c: pd.Series) -> pd.Series:
    """Unescaped, NFKC, decoding damage mended, blank runs and lines collapsed."""
    return c.map(_clean)


def _tail(paragraphs: list[str], most: int = 5) -> list[str]:
    out = [p for i, p in enumerate(paragraphs) if i == 0 or p != paragraphs[i - 1]]
    for n in range(min(most, len(out) // 2), 0, -1):
        while len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
            out = out[:-n]
    return out


@F.pandas_udf(StringType())
def drop_repeated_tail(c: pd.Series) -> pd.Series:
    """Neighbouring equal paragraphs once, and a repeated block of up to five last paragraphs once."""
    return c.map(lambda t: "\n".join(_tail([p for p in (t or "").split("\n") if p.strip()])))


def _summary(text: str | None, least: int = 30, most: int = 500, stops=("subscribe", "read more", "all rights reserved")) -> str:
    out, size = [], 0
    for s in re.split(r"(?<=[.!?])\s+", text or ""):
        if any(x in s.lower() for x in stops):
            break
        if len(s) < least:
            continue
        if size + len(s) > most and out:
            break
        out.append(s)
        size += len(s) + 1
    return " ".join(out)


@F.pandas_udf(StringType())
def summarize(c: pd.Series) -> pd.Series:
    """Leading sentences of some length, up to a size, until boilerplate begins."""
    return c.map(_summary)
