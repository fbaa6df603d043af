"""Cell semantics as column expressions: the two dialects of equality, key text, type names, name hints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a file's cell may have for no value (compared in lower case).
NULL_WORDS = ("(null)", "null", "none", "n/a", "na", "nan", "<null>", "#n/a", "")

# Name parts of key columns and of measure columns.
KEY_HINTS = ("id", "no", "code", "key", "编号", "主键", "单号", "流水", "号")
MEASURE_HINTS = (
    "amount", "amt", "qty", "quantity", "num", "count", "sum", "total", "price", "fee", "cost", "rate",
    "金额", "数量", "价", "费", "率",
)

# Texts for blank parts of a key.
KEY_NULL, KEY_EMPTY = "（NULL）", "（空字符串）"
CELL_NULL = "（数据库 NULL）"

#: White space as str.strip() has it; trim() by itself knows only the blank, and \\s only part of it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def kind_of(data_type: T.DataType) -> str:
    """text, whole numbers, plain decimals (of up to six places, which Spark writes without an exponent),
    decimals, times (dates among them), reals, or other: what a column's cells can look like as text."""
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(data_type, T.DecimalType) and data_type.scale > 0:
        return "plain" if data_type.scale <= 6 else "decimal"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "real" if isinstance(data_type, (T.FloatType, T.DoubleType)) else "other"


def plain_strip(c: Column) -> Column:
    """c without outer white space; a short expression, for those that use it many times."""
    return F.trim(c, F.lit(SPACE))


def strip(c: Column) -> Column:
    """c without outer white space; a text that begins and ends with visible ASCII has none."""
    visible = lambda x: F.ascii(x).between(33, 126)
    return F.when(visible(c) & visible(F.right(c, F.lit(1))), c).otherwise(plain_strip(c))


def trim_number(c: Column) -> Column:
    """Trailing zeros of a plain decimal text, and a then trailing point, removed."""
    return F.when(c.contains(".") & c.rlike(r"^-?[0-9]+\.[0-9]+$"), _short(c)).otherwise(c)


def _short(c: Column) -> Column:
    return F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))


def _plain_decimal(s: Column) -> Column:
    return s.rlike(r"^-?[0-9]+\.[0-9]+$")


def _fraction(s: Column) -> Column:
    """Whether s is a plain number with a point that isn't zero, but for zeros at its end."""
    return s.rlike(r"^-?([1-9][0-9]*\.[0-9]+|0\.0*[1-9][0-9]*)$")


@dataclass(frozen=True)
class FileDialect:
    """Equality of file cells: null and blank are one; by default case, outer white space, words
    for null and trailing zeros don't matter."""

    case_sensitive: bool = False
    trim_whitespace: bool = True
    null_equals_empty: bool = True
    strict_numeric: bool = False

    def __call__(self, c: Column, kind: str = "text") -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        if kind in ("whole", "time"):
            return s
        if kind in ("plain", "decimal"):
            return s if self.strict_numeric else _short(s) if kind == "plain" else trim_number(s)
        if self.trim_whitespace:
            s = strip(s)
        low = F.lower(s)
        out = s if self.case_sensitive else low
        if not self.strict_numeric:
            out = trim_number(out)
        return F.when(low.isin(*NULL_WORDS), "").otherwise(out) if self.null_equals_empty else out

    def key_part(self, raw: Column, norm: Column) -> Column:
        return F.coalesce(raw.cast("string"), F.lit(""))

    def but(self, **options: bool) -> "FileDialect":
        return replace(self, **options)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c with c computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def plain_number(s: Column) -> Column:
    """The plain text of a decimal number, without exponent, outer zeros, plus or minus zero; null
    for other texts. Exact for any number of digits: the point is moved within the text."""

    def moved(x: Column) -> Column:
        # digits and the place of the point among them, padded with zeros so that it lies within
        digits, point = x["digits"], x["point"]
        padded = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), 1 - point), digits)).otherwise(F.rpad(digits, F.greatest(F.length(digits), point), F.lit("0")))
        return let(F.struct(padded.alias("p"), F.greatest(point, F.lit(1)).alias("at")), cut)

    def cut(x: Column) -> Column:
        left = F.regexp_replace(F.substr(x["p"], F.lit(1), x["at"]), "^0+(?=[0-9])", "")
        right = F.regexp_replace(F.substr(x["p"], x["at"] + 1), "0+$", "")
        return let(F.struct(left.alias("l"), right.alias("r")), lambda y: F.when(y["r"] == "", y["l"]).otherwise(F.concat(y["l"], F.lit("."), y["r"])))

    def of(x: Column) -> Column:
        mantissa = lambda pattern: F.regexp_extract(x, r"^[+-]?" + pattern, 1)
        exponent = F.coalesce(F.regexp_extract(x, r"[eE]\+?(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        parts = F.struct(F.concat(mantissa(r"([0-9]*)"), mantissa(r"[0-9]*\.([0-9]*)")).alias("digits"), (F.length(mantissa(r"([0-9]*)")) + exponent).alias("point"))
        return let(let(parts, moved), lambda y: F.when(x.startswith("-") & (y != "0"), F.concat(F.lit("-"), y)).otherwise(y))

    plain = s.rlike(r"^(0|-?[1-9][0-9]*)$")
    return F.when(plain, s).when(_fraction(s), _short(s)).when(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), let(s, of))


@dataclass(frozen=True)
class SqlDialect:
    """Equality of result cells: null, blank, number and text are different kinds; numbers compare
    by value, but a text with a leading zero is an identifier. A value is kind and text in one."""

    def __call__(self, c: Column, kind: str = "text") -> Column:
        def of(s: Column) -> Column:
            code = s.rlike(r"^[+-]?0[0-9]+$") if kind == "text" else F.lit(False)
            text = F.concat(F.lit("text|"), s)
            number = let(plain_number(s), lambda n: F.coalesce(F.concat(F.lit("number|"), n), text))
            return F.when(s == "", "empty|").when(code, text).otherwise(number)

        number, s = F.lit("number|"), c.cast("string")
        if kind == "whole":
            return F.coalesce(F.concat(number, s), F.lit("null|"))
        if kind == "plain":
            return F.coalesce(F.concat(number, _short(s)), F.lit("null|"))
        if kind == "decimal":  # of one kind, without outer white space or leading zeros
            return F.when(c.isNull(), "null|").when(_plain_decimal(s), F.concat(number, _short(s))).otherwise(let(s, of))
        if kind == "time":
            return F.coalesce(F.concat(F.lit("text|"), s), F.lit("null|"))
        if kind == "real":  # without outer white space
            return F.when(c.isNull(), "null|").when(_fraction(s), F.concat(number, _short(s))).otherwise(let(s, of))
        first = F.ascii(s)
        word = first.between(33, 126) & ~first.between(48, 57) & ~first.isin(*map(ord, "+-."))  # no number starts so
        return F.when(c.isNull(), "null|").when(word, F.concat(F.lit("text|"), strip(s))).otherwise(let(strip(s), of))

    def key_part(self, raw: Column, norm: Column) -> Column:
        return F.when(norm == "null|", KEY_NULL).when(norm == "empty|", KEY_EMPTY).otherwise(F.substr(norm, F.instr(norm, "|") + 1))


Dialect = Callable[..., Column]


def key_text(parts: list[Column]) -> Column:
    """A single part as it is, several as a compact JSON array."""
    return parts[0] if len(parts) == 1 else F.to_json(F.array(*parts))


def display(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(CELL_NULL))


def base_type(c: Column) -> Column:
    """A type's name without length, precision or element types."""
    return F.trim(F.lower(F.split(c, r"[(<]")[0]))


def name_hit(name: str, hints: tuple[str, ...]) -> bool:
    """Whether a column's name is or has one of the hints as a word; longer ones, and those not of
    ASCII, count inside words too."""
    import re

    low = name.lower()
    words = {low, *re.split(r"[_\s\-]+", low)}
    return any(h in words or (len(h) > 3 and h in low) or (not h.isascii() and h in name) for h in hints)
