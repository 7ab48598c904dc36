"""Typed entity values: texts become int, float, datetime, bool, enum or text values.

Every parser is a struct that is null where it does not apply; the dispatcher is a coalesce of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese digits and powers.
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000, "兆": 1000000000000}
# What a unit multiplies its number by.
UNITS = {"元": 1, "美元": 1, "USD": 1, "$": 1, "万": 10000, "万元": 10000, "亿": 100000000, "亿元": 100000000, "克": 0.001, "g": 0.001, "kg": 1, "公斤": 1, "千克": 1, "吨": 1000, "米": 1, "m": 1, "公里": 1000, "km": 1000, "厘米": 0.01, "cm": 0.01, "秒": 1, "s": 1, "分钟": 60, "小时": 3600, "天": 86400}
# Words for true and false.
TRUE, FALSE = ["是", "对", "真", "yes", "true", "已", "有", "启用", "开启"], ["否", "错", "假", "no", "false", "未", "无", "禁用", "关闭"]
# Signs of money, measure words, words that tell a time.
MONEY = r"(?i)元|美元|USD|\$|¥|万元|亿元|块|角|分|块钱|毛|EUR|£|RMB|CNY|HKD|/月|/年|/天|/周|每月|每年|起|左右|约"
MEASURES = "个|件|条|项|批|次|笔|单|组"
TIME_WORDS = ["time", "date", "时间", "日期", "datetime"]

_FIELDS = (("int_value", "bigint"), ("float_value", "double"), ("datetime_value", "timestamp_ntz"), ("bool_value", "boolean"), ("enum_value", "string"))
_NUMBER = r"[\d,.]+(?:[eE][+-]?\d+)?"
_CN_RUN = "[一二三四五六七八九十百千万亿兆]+"


def _value(kind: str, value: Column, unit: Column | None, confidence: Column | float) -> Column:
    fields = [(value if name.startswith(kind) else F.lit(None)).cast(t).alias(name) for name, t in _FIELDS]
    unit = F.lit(None) if unit is None else F.when(unit != "", unit)
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(kind).alias("type"), *fields, unit.cast("string").alias("unit"), c.cast("double").alias("confidence"))


def _some(test: Column, value: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), value)


def chinese_number(text: Column) -> Column:
    """Read from the right: powers set or multiply the unit, digits are added times it; null for 0 or other signs."""
    digits = F.create_map(*[F.lit(x).cast(t) for k, v in CN_DIGITS.items() for x, t in ((k, "string"), (v, "bigint"))])
    n = F.transform(F.reverse(F.regexp_extract_all(text, F.lit("."), F.lit(0))), lambda c: F.try_element_at(digits, c))
    total = F.aggregate(
        n,
        F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(1).cast("bigint").alias("unit")),
        lambda a, x: F.struct(
            F.when(x < 10, a["total"] + x * a["unit"]).otherwise(a["total"]).alias("total"),
            F.when(x < 10, a["unit"]).when(x > a["unit"], x).otherwise(a["unit"] * x).alias("unit"),
        ),
        lambda a: a["total"],
    )
    return F.when(~F.exists(n, lambda x: x.isNull()) & (total > 0), total)


def _plain(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(""))


def with_unit(text: Column, unit: Column, force: str | None = None) -> Column:
    """A number before the configured unit, with or without a measure word between."""
    safe = F.concat(F.lit(r"\Q"), unit, F.lit(r"\E"))
    latin = F.concat(F.lit(f"(?i)^({_NUMBER})(?:{MEASURES})?"), safe, F.lit("$"))
    chinese = F.concat(F.lit(f"^({_CN_RUN})(?:{MEASURES})?"), safe, F.lit("$"))
    at = lambda p: F.regexp_extract(text, p, 1) if isinstance(p, str) else F.call_function("regexp_extract", text, p, F.lit(1))
    number, cn = _plain(at(latin)), chinese_number(F.when(at(chinese) != "", at(chinese)))
    real = number.rlike("[.eE]")
    whole, double = F.try_to_number(F.when(~real & (number != ""), number), F.lit("9" * 18)).cast("bigint"), number.try_cast("double")
    found = _some((unit.isNotNull()) & (number != "") & ~real & whole.isNotNull(), _value("int", whole, unit, 0.95))
    if force == "float":
        found = _some(unit.isNotNull() & double.isNotNull(), _value("float", double, unit, 0.95))
        return F.coalesce(found, _some(unit.isNotNull() & cn.isNotNull(), _value("float", cn, unit, 0.9)))
    if force is None:
        found = F.coalesce(found, _some(unit.isNotNull() & real & double.isNotNull(), _value("float", double, unit, 0.95)))
    return F.coalesce(found, _some(unit.isNotNull() & cn.isNotNull(), _value("int", cn, unit, 0.9)))


def number(text: Column, unit: Column | None = None, force: str | None = None) -> Column:
    """A number with a unit; whole results are ints. force: int refuses points and exponents, float makes all floats."""
    pattern = f"^({_NUMBER})\\s*([a-zA-Z一-龥]*)$"
    digits, own = _plain(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    factors = F.create_map(*[F.lit(x).cast(t) for k, v in UNITS.items() for x, t in ((k, "string"), (v, "double"))])
    factor = F.coalesce(F.try_element_at(factors, own), F.lit(1.0))
    value, real = digits.try_cast("double") * factor, digits.rlike("[.eE]")
    exact = _some(~real & (factor == F.floor(factor)), digits.try_cast("bigint") * factor.cast("bigint"))
    whole = F.coalesce(exact, _some((value == F.floor(value)) & (F.abs(value) < 9e18), value.cast("bigint")))
    cn = F.when((F.length(text) <= 6) & text.rlike(f"^{_CN_RUN}$"), chinese_number(text))
    if force == "int":
        # a point or exponent ends it; a part of a unit is cut off
        found = _some(~real, _value("int", F.coalesce(exact, value.cast("bigint")), own, 0.95))
        chinese = _some(cn.isNotNull() & (digits == ""), _value("int", cn, None, 0.85))
        found = F.when(value.isNotNull(), found).otherwise(chinese)
    elif force == "float":
        found = F.coalesce(_some(value.isNotNull(), _value("float", value, own, 0.95)), _some(cn.isNotNull(), _value("float", cn, None, 0.85)))
    else:
        found = F.coalesce(_some(whole.isNotNull(), _value("int", whole, own, 0.95)), _some(value.isNotNull(), _value("float", value, own, 0.95)), _some(cn.isNotNull(), _value("int", cn, None, 0.85)))
    return found if unit is None else F.coalesce(with_unit(text, unit, force), found)


def _stamp(text: Column, pattern: str, parts: int, confidence: float, test: Column | None = None) -> Column:
    got = [F.regexp_extract(text, pattern, k + 1).try_cast("int") for k in range(parts)] + [F.lit(1)] * (3 - min(parts, 3)) + [F.lit(0)] * (6 - max(parts, 3))
    stamp = F.try_make_timestamp_ntz(*got[:5], got[5].cast("decimal(8,6)"))
    return _some(stamp.isNotNull() & (test if test is not None else F.lit(True)), _value("datetime", stamp, None, confidence))


def date_time(text: Column) -> Column:
    """Seconds, minutes, day, month, year, in this order; a year alone only from 1970 to 2099 and without signs of money."""
    t = F.translate(F.translate(text, "年月", "--"), "日", "")
    t = F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-+|-+$", "")
    day = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    year = F.regexp_extract(t, r"^(\d{4})(?:[^\d]|$)", 1).try_cast("int")
    return F.coalesce(
        _stamp(t, day + r"[\sT]+(\d{1,2}):(\d{1,2}):(\d{1,2})", 6, 0.98),
        _stamp(t, day + r"[\sT]+(\d{1,2}):(\d{1,2})", 5, 0.95),
        _stamp(t, day, 3, 0.98),
        _stamp(t, r"(\d{4})-(\d{1,2})(?:[^\d]|$)", 2, 0.90),
        _stamp(t, r"^(\d{4})(?:[^\d]|$)", 1, 0.85, year.between(1970, 2099) & ~text.rlike(MONEY)),
    )


def compact_date_time(text: Column) -> Column:
    """14, 12, 8 or 6 digits; null where they are no date."""
    return F.coalesce(
        _stamp(text, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", 6, 0.95),
        _stamp(text, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)$", 5, 0.92),
        _stamp(text, r"^(\d{4})(\d\d)(\d\d)$", 3, 0.95),
        _stamp(text, r"^(\d{4})(\d\d)$", 2, 0.90),
    )


def boolean(text: Column) -> Column:
    t = F.lower(text)
    return F.when(F.length(text) <= 10, F.when(t.isin(TRUE), _value("bool", F.lit(True), None, 0.95)).when(t.isin(FALSE), _value("bool", F.lit(False), None, 0.95)))


def enum(text: Column, values: Column) -> Column:
    """An exact value, else the first that contains the text or lies in it, else UNKNOWN; null without a list."""
    low = F.lower(text)
    like = F.get(F.filter(values, lambda v: low.contains(F.lower(v)) | F.lower(v).contains(low)), 0)
    found = F.when(F.array_contains(values, text), _value("enum", text, None, 1.0)).when(like.isNotNull(), _value("enum", like, None, 0.8))
    return F.when(values.isNotNull(), F.coalesce(found, _value("enum", F.lit("UNKNOWN"), None, 0.0)))


def plain_text(text: Column) -> Column:
    return _value("text", F.lit(None), None, 1.0)


def parse_value(text: Column, category: Column | None = None, entity_type: Column | None = None, kind: Column | None = None, unit: Column | None = None, enum_values: Column | None = None) -> Column:
    """The typed value of a text; null for an empty one, and where it does not fit a kind that is asked for."""
    none = F.lit(None).cast("string")
    category, entity_type, kind, unit = (none if x is None else x for x in (category, entity_type, kind, unit))
    values = F.lit(None).cast("array<string>") if enum_values is None else enum_values
    t = F.trim(text)
    strict = (
        F.when(kind == "int", number(t, unit, "int")).when(kind == "float", number(t, unit, "float")).when(kind == "enum", enum(t, values))
        .when(kind == "datetime", F.coalesce(compact_date_time(t), date_time(t))).when(kind == "bool", boolean(t)).when(kind == "text", plain_text(t))
    )
    timely = F.coalesce(F.lower(category).isin(TIME_WORDS), F.lit(False)) | F.coalesce(F.lower(entity_type).rlike("时间|日期|time|date"), F.lit(False))
    free = F.coalesce(F.when(timely, compact_date_time(t)), date_time(t), number(t, unit), enum(t, values), boolean(t), plain_text(t))
    return F.when(t != "", F.when(kind.isNotNull(), strict).otherwise(free))


def typed_value(value: Column) -> Column:
    """The value as text, whichever of the typed columns holds it; null for a text value."""
    return F.coalesce(*[value[name].cast("string") for name, _ in _FIELDS])
