"""Typed values of facts: normal forms, canonical text and three-valued comparison.

A normal form is a struct (kind, value, unit, currency, day). What can't be read is null, and null
compared with anything is null: incomparable, never different.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text

DECIMAL = "decimal(38,10)"
# Markers of the currencies, in order of precedence.
CURRENCIES = {"CNY": ("人民币", "CNY", "RMB", "￥", "¥"), "USD": ("美元", "USD", "US$"), "EUR": ("欧元", "EUR", "€"), "HKD": ("港币", "港元", "HKD", "HK$")}
NUMERIC_KINDS = ("MONEY", "PERCENTAGE", "RATE", "DURATION", "NUMBER", "QUANTITY")


def currency(text: Column) -> Column:
    upper = F.upper(text)
    out = F.lit(None).cast("string")
    for code, marks in reversed(CURRENCIES.items()):
        found = upper.contains(marks[0].upper())
        for m in marks[1:]:
            found = found | upper.contains(m.upper())
        out = F.when(found, code).otherwise(out)
    return out


def number(text: Column) -> Column:
    """The first number of a text, commas ignored."""
    return F.regexp_extract(F.regexp_replace(text, "[,，]", ""), r"[-+]?\d+(?:\.\d+)?", 0).try_cast(DECIMAL)


def scaled(text: Column) -> Column:
    """The first number times 1e8 for 亿 or 1e4 for 万."""
    n = number(text)
    return F.when(text.contains("亿"), n * F.lit(10**8)).when(text.contains("万"), n * F.lit(10**4)).otherwise(n).cast(DECIMAL)


def _form(kind: str | Column, value: Column | None = None, unit: Column | None = None, cur: Column | None = None, day: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (F.lit(None) if value is None else value).cast(DECIMAL).alias("value"), (text if unit is None else unit).alias("unit"), (text if cur is None else cur).alias("currency"), (text if day is None else day).alias("day"))


def normal_form(raw: Column, kind: Column) -> Column:
    """The normal form of a raw value of a kind, or null."""
    raw = normalize_text(raw)
    money = scaled(raw)
    points = F.when(raw.rlike("(?i)BP|基点"), number(raw) / 100).otherwise(number(raw)).cast(DECIMAL)
    length = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)\s*(年|个月|月|周|天|日)", 1).try_cast(DECIMAL)
    unit = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)\s*(年|个月|月|周|天|日)", 2)
    part = lambda i: F.regexp_extract(raw, r"(\d{4})[年./-](\d{1,2})[月./-](\d{1,2})日?", i)
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    measure = F.nullif(F.lower(F.regexp_extract(F.regexp_replace(raw, ",", ""), r"[-+]?\d+(?:\.\d+)?\s*([\u4e00-\u9fffA-Za-z]+)", 1)), F.lit(""))
    return (
        F.when((kind == "MONEY") & money.isNotNull(), _form("MONEY", money, cur=currency(raw)))
        .when(kind.isin("PERCENTAGE", "RATE") & raw.rlike("(?i)%|百分之|BP|基点") & points.isNotNull(), _form("PERCENTAGE", points, F.lit("PERCENT_POINT")))
        .when((kind == "DURATION") & length.isNotNull() & (unit == "年"), _form("DURATION", length * 12, F.lit("MONTH")))
        .when((kind == "DURATION") & length.isNotNull() & unit.isin("个月", "月"), _form("DURATION", length, F.lit("MONTH")))
        .when((kind == "DURATION") & length.isNotNull(), _form("DURATION", F.when(unit == "周", length * 7).otherwise(length), F.lit("DAY")))
        .when((kind == "DATE") & day.isNotNull(), _form("DATE", day=day.cast("string")))
        .when(kind.isin("NUMBER", "QUANTITY") & number(raw).isNotNull(), _form(kind, number(raw), measure))
    )


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros; whole tens in exponent form (1E+7), as normalised decimals are written."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    zeros = F.length(F.regexp_extract(plain, r"^-?\d*[1-9](0+)$", 1))
    digits = F.regexp_replace(plain, "0+$", "")
    bare = F.regexp_replace(digits, "^-", "")
    more = F.length(bare) - 1
    mantissa = F.when(more > 0, F.concat(F.regexp_extract(digits, r"^(-?\d)", 1), F.lit("."), F.substring(bare, F.lit(2), more))).otherwise(digits)
    return F.when(plain.rlike(r"^-?0$"), "0").when(zeros > 0, F.concat(mantissa, F.lit("E+"), (zeros + more).cast("string"))).otherwise(plain)


def canonical(form: Column, raw: Column, kind: Column, hint: Column | None = None) -> Column:
    """KIND:value text of a normal form; of unreadable values the hint or raw text without punctuation."""
    value = decimal_text(form["value"])
    tail = F.when(form["unit"].isNotNull(), F.concat(F.lit(":"), form["unit"])).otherwise("")
    money = F.when(form["currency"].isNotNull(), F.concat(F.lit(":"), form["currency"])).otherwise("")
    rest = F.coalesce(F.nullif(normalize_text(hint), F.lit("")), normalize_text(raw)) if hint is not None else normalize_text(raw)
    rest = F.lower(F.regexp_replace(rest, r"(?U)[\s·•,，。.;；:：()（）\[\]【】]", ""))
    return (
        F.when(form.isNull(), F.concat(kind, F.lit(":"), rest))
        .when(form["kind"] == "MONEY", F.concat(F.lit("MONEY:"), value, money))
        .when(form["kind"] == "PERCENTAGE", F.concat(F.lit("PERCENTAGE:"), value, F.lit("%")))
        .when(form["kind"] == "DURATION", F.concat(F.lit("DURATION:"), value, F.when(form["unit"] == "MONTH", "M").otherwise("D")))
        .when(form["kind"] == "DATE", F.concat(F.lit("DATE:"), form["day"]))
        .otherwise(F.concat(form["kind"], F.lit(":"), value, tail))
    )


def same_value(a: Column, b: Column, kind_a: Column, kind_b: Column, text_a: Column, text_b: Column) -> Column:
    """true, false, or null where two normal forms (canonical texts text_a, text_b) can't be compared."""
    typed = [*NUMERIC_KINDS, "DATE"]
    alike = (a["kind"] == b["kind"]) & a["unit"].eqNullSafe(b["unit"]) & a["currency"].eqNullSafe(b["currency"])
    equal = F.when(a["kind"] == "DATE", a["day"] == b["day"]).otherwise(a["value"] == b["value"])
    either = F.when(~kind_a.isin(typed) & ~kind_b.isin(typed), text_a == text_b)
    return F.when(a.isNull() | b.isNull(), either).when(alike, equal)


