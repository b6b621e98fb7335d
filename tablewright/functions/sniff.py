"""Column expressions that classify and order cells the way the pipelines expect.

Cells of text columns are classified on use (filter, sort, min/max, profile):
boolean, timestamp, date, integer, number or string, tested in that order.
Everything here builds plain Spark ``Column`` expressions (JVM side, no
Python UDF), plus a Python twin of the classifier for literals, which are
classified once on the driver when the plan is built.
"""

from __future__ import annotations

import datetime as _dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the behaviour pipelines were written against).
# JavaScript String.prototype.trim removes exactly these code points:
# tab, LF, VT, FF, CR, space, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000, U+FEFF.  U+200B is NOT in the set.
JS_WHITESPACE = (
    "\t\n\u000b\u000c\r   "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　﻿"
)
# Cell patterns (case-insensitive where noted):
#   timestamp: YYYY-MM-DD, 'T' or space, HH:MM, optional :SS and .fraction,
#              optional Z or +hh, +hhmm, +hh:mm (case-insensitive)
#   date:      YYYY-MM-DD that is a real calendar day
#   integer:   optional sign and digits, no leading zero before another digit
#   number:    optional sign, digits with a point and/or exponent
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt ][0-2]\d:[0-5]\d(:[0-5]\d(\.\d+)?)?([Zz]|[+-][0-2]\d(:?[0-5]\d)?)?$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
INTEGER_PATTERN = r"^[+-]?\d+$"
NUMBER_PATTERN = r"^[+-]?(\d+\.\d*|\d*\.\d+|\d+)([eE][+-]?\d+)?$"
LEADING_ZERO_PATTERN = r"^[+-]?0\d"
NO_LEADING_ZERO = r"^(?![+-]?0\d)"
BOOLEAN_PATTERN = r"^(?i)(true|false)$"
# ---------------------------------------------------------------------------

COLLATION = "UNICODE_CI_AI"

CLASSES = ("boolean", "timestamp", "date", "integer", "number", "string", "array", "object")

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC_TYPES = INTEGRAL_TYPES + FRACTIONAL_TYPES
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(dtype: T.DataType) -> str:
    """Type family used for join-key compatibility and union widening."""
    if isinstance(dtype, NUMERIC_TYPES):
        return "number"
    if isinstance(dtype, TIME_TYPES):
        return "time"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return "text"
    if isinstance(dtype, T.NullType):
        return "null"
    return "nested:" + dtype.simpleString()


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(JS_WHITESPACE))


def parse_timestamp(text: Column) -> Column:
    """ISO-like text to TIMESTAMP (UTC session zone); null when not a real instant."""
    norm = F.regexp_replace(text, r"[zZ]$", "Z")
    norm = F.regexp_replace(norm, r"([+-]\d\d)(\d\d)$", "$1:$2")
    norm = F.regexp_replace(norm, r"^(\d{4}-\d{2}-\d{2}[Tt ]\d\d:\d\d)(?=$|[^:\d])", "$1:00")
    return F.try_to_timestamp(norm)


def is_real_date(text: Column) -> Column:
    """Strict YYYY-MM-DD that names a real day (years below 100 are rejected,
    as the reference's UTC round trip maps them to 19xx)."""
    return (
        text.rlike(DATE_PATTERN)
        & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
        & (F.substring(text, 1, 4).cast("int") >= 100)
    )


def text_class(col: Column, labels: dict | None = None) -> Column:
    """Class of a text cell: null for null, 'none' for '' or whitespace only.
    ``labels`` maps class names to other literals (e.g. bit values)."""
    lab = (lambda name: F.lit(labels[name])) if labels else (lambda name: F.lit(name))
    t = js_trim(col)
    return (
        F.when(col.isNull(), F.lit(None))
        .when(t == "", lab("none"))
        # cheap guard: every non-text class starts with a digit, sign, point, t or f
        .when(~t.rlike("^[-+.0-9tTfF]"), lab("string"))
        .when(t.rlike(BOOLEAN_PATTERN), lab("boolean"))
        .when(t.rlike(TIMESTAMP_PATTERN) & parse_timestamp(t).isNotNull(), lab("timestamp"))
        .when(is_real_date(t), lab("date"))
        .when(t.rlike(INTEGER_PATTERN) & ~t.rlike(LEADING_ZERO_PATTERN), lab("integer"))
        .when(t.rlike(NUMBER_PATTERN) & ~t.rlike(LEADING_ZERO_PATTERN), lab("number"))
        .otherwise(lab("string"))
    )


def visible_trim(col: Column) -> Column:
    """:func:`js_trim` of a plain column: ends that are visible ASCII leave nothing to trim, which is cheaper to see."""
    last = F.substring(col, -1, 1)
    return F.when((col >= "!") & (col < "\x7f") & (last >= "!") & (last < "\x7f"), col).otherwise(js_trim(col))


def trimmed_class(t: Column, labels: dict) -> Column:
    """:func:`text_class` of a column that holds trimmed text.  Comparing it with single characters tells
    what it starts with, so that one pattern or two are left to match."""
    lab = lambda name: F.lit(labels[name])
    starts = lambda first, last: (t >= first) & (t < chr(ord(last) + 1))
    dashed = starts("0", "9") & (F.substring(t, 5, 1) == "-")
    real_date = (F.length(t) == 10) & t.rlike(DATE_PATTERN) & t.try_cast("date").isNotNull() & (t >= "0100")
    return (
        F.when(t.isNull(), F.lit(None))
        .when(t == "", lab("none"))
        .when(starts("f", "f") | starts("t", "t") | starts("F", "F") | starts("T", "T"),
              F.when(t.rlike(BOOLEAN_PATTERN), lab("boolean")).otherwise(lab("string")))
        .when(~(starts("0", "9") | starts("+", ".")), lab("string"))
        .when(dashed & real_date, lab("date"))
        .when(dashed & t.rlike(TIMESTAMP_PATTERN) & parse_timestamp(t).isNotNull(), lab("timestamp"))
        .when(t.rlike(NO_LEADING_ZERO + NUMBER_PATTERN[1:]),  # an integer is a number without point and exponent
              F.when(t.contains(".") | t.contains("e") | t.contains("E"), lab("number")).otherwise(lab("integer")))
        .otherwise(lab("string"))
    )


def cell_class(col: Column, dtype: T.DataType, labels: dict | None = None) -> Column:
    """Class of any cell given its Spark type."""
    lab = (lambda name: F.lit(labels[name])) if labels else (lambda name: F.lit(name))
    if isinstance(dtype, T.StringType):
        return text_class(col, labels)
    if isinstance(dtype, T.BooleanType):
        label = lab("boolean")
    elif isinstance(dtype, INTEGRAL_TYPES):
        label = lab("integer")
    elif isinstance(dtype, FRACTIONAL_TYPES):
        d = col.cast("double")
        label = F.when(F.isnan(d) | (F.abs(d) == float("inf")), lab("number")) \
            .when(d == F.floor(d), lab("integer")).otherwise(lab("number"))
    elif isinstance(dtype, T.DateType):
        label = lab("date")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        label = lab("timestamp")
    elif isinstance(dtype, T.ArrayType):
        label = lab("array")
    elif isinstance(dtype, (T.StructType, T.MapType)):
        label = lab("object")
    else:
        label = lab("string")
    return F.when(col.isNull(), F.lit(None)).otherwise(label)


# -- natural order ---------------------------------------------------------

#: Digits of the length written before each run of digits.
LENGTH_DIGITS = 10


def natural_key(text: Column) -> Column:
    """Collated key giving natural text order: digit runs compare by value,
    case and accents are ignored (``Item2`` = ``item002`` < ``item10``).

    Every digit run loses its leading zeros and gets its length in front, so
    longer runs sort after shorter ones and equal lengths digit by digit; runs
    of any length compare exactly.  Texts without digits are their own key."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def keyed(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        size = F.lpad(F.length(digits).cast("string"), LENGTH_DIGITS, "0")
        return F.when(part.rlike(r"^\d"), F.concat(size, digits)).otherwise(part)

    fixed = F.when(text.rlike(r"\d"), F.array_join(F.transform(parts, keyed), "")).otherwise(text)
    return F.collate(fixed, COLLATION)


def natural_key_py(text: str) -> str:
    """Driver-side twin of :func:`natural_key` for literals (uncollated)."""
    def keyed(match: re.Match) -> str:
        digits = match.group(0).lstrip("0") or "0"
        return str(len(digits)).zfill(LENGTH_DIGITS) + digits
    return re.sub(r"[0-9]+", keyed, text)


def natural_literal(text: str) -> Column:
    return F.collate(F.lit(natural_key_py(text)), COLLATION)


# -- text forms --------------------------------------------------------------

def js_number_text(col: Column) -> Column:
    """Text form of a double the way JavaScript prints numbers:
    ``1`` not ``1.0``; plain digits from 1e-6 up to 1e21; ``1e+21`` / ``1e-7``
    beyond; NaN and infinities by name."""
    d = col.cast("double")
    raw = F.abs(d).cast("string")                      # 100.0, 12345678.5, 1.0E21, 1.0E-7
    int_part = F.regexp_extract(raw, r"^(\d+)", 1)
    frac_part = F.regexp_extract(raw, r"^\d+\.(\d+)", 1)
    exp_text = F.regexp_extract(raw, r"E(-?\d+)$", 1)
    exp = F.when(exp_text == "", F.lit(0)).otherwise(exp_text.cast("int"))
    all_digits = F.concat(int_part, frac_part)
    lead = F.length(all_digits) - F.length(F.regexp_replace(all_digits, r"^0+", ""))
    digits = F.regexp_replace(F.regexp_replace(all_digits, r"^0+", ""), r"0+$", "")
    point = F.length(int_part) + exp - lead            # digits before the decimal point
    n = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.rpad(digits, point, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    sci_exp = point - 1
    sci = F.concat(
        F.substring(digits, 1, 1),
        F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")),
        F.lit("e"), F.when(sci_exp >= 0, F.lit("+")).otherwise(F.lit("")), sci_exp.cast("string"),
    )
    ad = F.abs(d)
    # between 1e-3 and 1e7 the cast has no exponent: at most a ".0" goes; whole numbers up to 2^53 print as integers
    short = F.when(raw.endswith(".0"), F.substring(raw, F.lit(1), F.length(raw) - 2)).otherwise(raw)
    whole = ad.cast("long").cast("string")
    body = (F.when((ad >= 1e-3) & (ad < 1e7), short).when((ad < 9007199254740992.0) & (ad >= 1) & (ad == F.floor(ad)), whole)
            .when((ad >= 1e21) | (ad < 1e-6), sci).otherwise(plain))
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("NaN"))
        .when(d == float("inf"), F.lit("Infinity"))
        .when(d == float("-inf"), F.lit("-Infinity"))
        .when(d == 0, F.lit("0"))
        .otherwise(F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), body))
    )


def iso_millis(col: Column) -> Column:
    """Timestamp as ISO-8601 UTC text with milliseconds and ``Z``."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text_form(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell as the reference stringifies it (numbers JS-style,
    timestamps ISO with ms, nested values as JSON)."""
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit("true")).when(~col, F.lit("false"))
    if isinstance(dtype, INTEGRAL_TYPES):
        return col.cast("string")
    if isinstance(dtype, T.DecimalType):
        return js_number_text(col.cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return js_number_text(col)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return iso_millis(col)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    return col.cast("string")


# -- numeric and time values of text cells --------------------------------------

def number_of_text(t: Column) -> Column:
    """Double of trimmed text in decimal or exponent syntax; null when the
    text is not a finite number (hex, octal and binary text are not)."""
    v = F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
    return F.when(F.abs(v) == float("inf"), F.lit(None).cast("double")).otherwise(v)


def epoch_millis_of_text(t: Column) -> Column:
    """Epoch ms of a date or timestamp text cell (dates at UTC midnight)."""
    return F.unix_millis(parse_timestamp(t))


# -- sort keys -------------------------------------------------------------------

def sort_key_fields(col: Column, dtype: T.DataType, cls: Column | None = None) -> list[tuple[Column, bool]]:
    """Ordered list of (key, reversible) parts giving the reference's total order
    for one column: missing (null or '') last, then typed value; text cells by
    rank (0 numeric/date/boolean, 1 text), numeric value, natural key.

    Returns (expr, is_missing_flag) pairs; the caller applies direction to
    every part except the missing flag.  ``cls`` is the cell's class when a
    projection below has computed it already.
    """
    if isinstance(dtype, T.StringType):
        t = js_trim(col)
        cls = text_class(col) if cls is None else cls
        missing = col.isNull() | (col == "")
        num = (
            F.when(cls.isin("integer", "number"), t.try_cast("double"))
            .when(cls.isin("date", "timestamp"), epoch_millis_of_text(t).cast("double"))
            .when(cls == "boolean", F.when(F.lower(t) == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        )
        rank = F.when(missing, F.lit(None)).when(num.isNotNull(), F.lit(0)).otherwise(F.lit(1))
        nat = F.when(~missing & num.isNull(), natural_key(col))
        return [(missing, True), (rank, False), (num, False), (nat, False)]
    missing = col.isNull()
    if isinstance(dtype, T.BooleanType):
        return [(missing, True), (col, False)]
    return [(missing, True), (col, False)]


# -- Python twin for literals -----------------------------------------------------

_TS_RE = re.compile(TIMESTAMP_PATTERN)
_DATE_RE = re.compile(DATE_PATTERN)
_INT_RE = re.compile(INTEGER_PATTERN)
_NUM_RE = re.compile(NUMBER_PATTERN)
_LZ_RE = re.compile(LEADING_ZERO_PATTERN)


def py_trim(text: str) -> str:
    return text.strip(JS_WHITESPACE)


def py_parse_timestamp(text: str) -> _dt.datetime | None:
    norm = re.sub(r"[zZ]$", "+00:00", text.replace("t", "T", 1) if "t" in text[10:11] else text)
    norm = re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", norm)
    norm = re.sub(r"([+-]\d\d)$", r"\1:00", norm)
    try:
        value = _dt.datetime.fromisoformat(norm.replace(" ", "T", 1))
    except ValueError:
        return None
    if value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return value


def py_is_real_date(text: str) -> bool:
    if not _DATE_RE.match(text):
        return False
    try:
        day = _dt.date.fromisoformat(text)
    except ValueError:
        return False
    return day.year >= 100


def py_class(value) -> str | None:
    """Class of a Python literal with the same rules as :func:`text_class`."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "integer" if math.isfinite(value) and value.is_integer() else "number"
    if isinstance(value, _dt.datetime):
        return "timestamp"
    if isinstance(value, _dt.date):
        return "date"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "object"
    text = py_trim(str(value))
    if value == "":
        return None
    if not text:
        return "none"
    if re.match(r"^(?i:true|false)$", text):
        return "boolean"
    if _TS_RE.match(text) and py_parse_timestamp(text) is not None:
        return "timestamp"
    if py_is_real_date(text):
        return "date"
    if _INT_RE.match(text) and not _LZ_RE.match(text):
        return "integer"
    if _NUM_RE.match(text) and not _LZ_RE.match(text):
        return "number"
    return "string"


def py_text(value) -> str:
    """Text form of a Python literal (JS-style numbers)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        return repr(value)
    if isinstance(value, _dt.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, _dt.date):
        return value.isoformat()
    return str(value)
