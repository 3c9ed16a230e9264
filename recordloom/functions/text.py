"""Scalar text, date, URL and clause functions, on the JVM wherever Spark can express them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: White space as ECMAScript has it; Java's \s lacks the last ones.
SPACE = r"[\s   -     　﻿]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def stable_text(text: Column) -> Column:
    """NFKC, punctuation folded, runs of white space one space, trimmed. NFKC is the one step Spark lacks."""
    folded = F.translate(_nfkc(text), "".join(fixed.PUNCTUATION), "".join(fixed.PUNCTUATION.values()))
    return F.trim(F.regexp_replace(folded, f"{SPACE}+", " "))


def location_name(text: Column) -> Column:
    """stable_text without white space, municipalities by their short names."""
    compact = F.regexp_replace(stable_text(text), f"{SPACE}+", "")
    names = F.create_map(*[F.lit(x) for pair in fixed.MUNICIPALITIES.items() for x in pair])
    return F.coalesce(names[compact], compact)


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD of the first year, month, day in the text, as text: the calendar isn't asked. Null if there is none."""
    part = lambda i: F.regexp_extract(text, fixed.DATE, i)
    found = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", found)


def year_of(text: Column) -> Column:
    """The first 20xx that is not part of a longer number."""
    found = F.regexp_extract(text, fixed.YEAR, 1)
    return F.when(found != "", found.cast("int"))


def labelled_date(text: Column, labels: list[str], reach: int = fixed.LABEL_REACH) -> Column:
    """iso_date of the up to `reach` characters of one clause that follow the first of the labels."""
    context = F.regexp_extract(text, "(?:" + "|".join(map(re.escape, labels)) + f")[：:\\s]*([^，。；;\\n]{{0,{reach}}})", 1)
    return iso_date(context)


def deadline(text: Column) -> Column:
    return labelled_date(text, fixed.DEADLINE_LABELS)


def start_date(text: Column) -> Column:
    return labelled_date(text, fixed.START_LABELS)


def education(text: Column) -> Column:
    """The education class of the first wording that the text holds."""
    return first_class(text, fixed.EDUCATION, fixed.EDUCATION_OTHERWISE)


def cities_in(text: Column, cities: list[str] = fixed.CITIES, most: int = 4, otherwise: str = "全国/未注明") -> Column:
    """Up to `most` of the listed cities, in list order."""
    found = F.filter(F.array(*map(F.lit, cities)), lambda c: F.contains(text, c))
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, most), "、")).otherwise(F.lit(otherwise))


def first_class(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The class of the first (pattern, class) that the text matches: a cascade as a table."""
    out = F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in rules])
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def first_listed(text: Column, terms: list[str], otherwise: Column | None = None) -> Column:
    """The first listed term that the text contains."""
    hits = [F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]
    return F.coalesce(*hits, *([otherwise] if otherwise is not None else []))


def mail_link(text: Column) -> Column:
    found = F.regexp_extract(text, fixed.MAIL, 0)
    return F.when(found != "", F.concat(F.lit("mailto:"), found))


def html_text(html: Column) -> Column:
    """Text of an HTML string: scripts, styles and comments out, block ends are line breaks, other tags out, basic entities decoded."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table|nav|header|footer|title)\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f 　]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


@F.pandas_udf(T.StringType())
def _gbk(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decoded(data: Column, charset: Column) -> Column:
    """Text of bytes: GBK (which Spark's decode lacks) where the charset says so, else UTF-8, null where that is not valid."""
    wide = F.coalesce(F.lower(charset).isin("gbk", "gb2312", "gb18030"), F.lit(False))
    return F.when(wide, _gbk(F.when(wide, data))).otherwise(F.try_validate_utf8(F.when(~wide, data).cast("string")))


def clauses(text: Column) -> Column:
    """array<struct<place, text, start, end>>: trimmed clauses between `; ；。` and line breaks, with code point offsets, end not included."""
    marks = F.split(F.regexp_replace(text, r"([;；。\n]+)", "\u0001$1\u0001"), "\u0001")
    steps = F.aggregate(
        marks, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(F.trim(F.regexp_replace(p, r"[;；。\s]+", "")) == "", s["out"]).otherwise(
                F.concat(s["out"], F.array(F.struct(
                    F.regexp_replace(p, r"^\s+|\s+$", "").alias("text"),
                    (s["at"] + F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))).cast("int").alias("start"),
                    (s["at"] + F.length(F.regexp_replace(p, r"\s+$", ""))).cast("int").alias("end"))))).alias("out")),
    )
    return F.transform(steps["out"], lambda c, i: F.struct((i + 1).alias("place"), c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end")))


def unmarked(clause: Column) -> Column:
    """A clause without its leading list marker: `1.`, `一、`, `(2)`, `①`."""
    return F.regexp_replace(clause, r"^\s*(?:[(（]?(?:\d{1,2}|[一二三四五六七八九十]{1,3})[)）.、．:：]|[①-⑳])\s*", "")


def _split_outside(text: str | None, protected: tuple[str, ...]) -> list[str] | None:
    if text is None:
        return None
    parts, depth, begin, i = [], 0, 0, 0
    while i < len(text):
        whole = next((p for p in protected if text.startswith(p, i)), None)
        if whole:
            i += len(whole)
            continue
        c = text[i]
        depth += (c in "(（") - (c in ")）" and depth > 0)
        if depth == 0 and c in ",，、/":
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    return [p.strip() for p in [*parts, text[begin:]] if p.strip()]


def split_outside(text: Column, protected: tuple[str, ...] = ()) -> Column:
    """Items of a list between `, ， 、 /`, but not within parentheses or the protected phrases."""
    whole = tuple(sorted(protected, key=len, reverse=True))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _split_outside(t, whole))

    return run(text)


def full_years(birth: Column, at: Column) -> Column:
    """Calendar age: a birthday counts from its own day on."""
    before = F.date_format(at, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(at) - F.year(birth) - before.cast("int")


def local_date(instant: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def next_run(completed: Column, every_s: Column, least_s: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(completed) + F.greatest(every_s, least_s))


def clamped(score: Column, low: int = 1, high: int = 5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def url_canonical(url: Column, keep_slash: bool = False) -> Column:
    """http(s) URL without its fragment, host in lower case, runs of slashes one, query pairs sorted; null for others.

    The path's last slash goes unless keep_slash or the path is a slash alone.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^(?i)https?://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i)https?://[^/?]*([^?]*)", 1), "/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    if not keep_slash:
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(pairs == "", "").otherwise(F.concat(F.lit("?"), pairs)))
    return F.when((scheme != "") & (host != "") & ~F.contains(host, F.lit("@")), out)


def safe_url(url: Column) -> Column:
    """https, no user, no fragment, not a local or private address."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]*)", 1))
    private = host.rlike(r"^(localhost|.*\.local|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|169\.254\..*|0\..*|\[.*)$")
    return F.coalesce((host != "") & ~private & ~url.rlike("#") & ~F.regexp_extract(url, r"^https://([^/?#]*)", 1).rlike("@"), F.lit(False))


def detail_url(url: Column) -> Column:
    """Whether a URL leads to one posting: list pages are none, whatever else they match."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    listing, detail = path.rlike("|".join(fixed.LIST_PATHS)), path.rlike("|".join(fixed.DETAIL_PATHS))
    keyed = F.arrays_overlap(keys, F.array(*map(F.lit, fixed.DETAIL_NAMES)))
    return F.coalesce(~listing & (detail | keyed), F.lit(False))


def redacted(headers: Column, sensitive: str = "(?i)authorization|cookie|token|secret|password|api[-_]?key|session") -> Column:
    """A map without entries whose name is sensitive."""
    return F.map_filter(headers, lambda k, v: ~k.rlike(sensitive))


def csv_cell(cell: Column, guard: bool = True) -> Column:
    """A quoted CSV cell; with guard, one that a spreadsheet could run as a formula begins with an apostrophe."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    if guard:
        text = F.when(text.rlike("^[=+@\\-\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
