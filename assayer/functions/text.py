"""Reading numbers and dates out of text, and writing values as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions import predicates as P

# Text that stands for a missing value in delimited files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed patterns.
PLAIN_INTEGER = r"^-?[0-9]+$"
SIGNED_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE_NUMBER = r"^(?i)\s*[+-]?inf(inity)?\s*$"
NUMBER_LIKE = (
    r"^(?i)\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)\s*$"
)
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

# Fixed layouts of dates besides ISO ones: days of three numbers, days with the name of their
# month, what may follow them, and forms that stand alone. Where a text fits two of them, the
# month comes first if it can.
NUMBERED_DAYS = tuple(f"{a}{s}{b}{s}y" for s in "/-." for a, b in ("Md", "dM"))
NAMED_DAYS = (
    "d MMM y", "d MMMM y", "d-MMM-y", "d-MMMM-y", "MMM d,[ ]y", "MMMM d,[ ]y", "MMM d y",
    "MMMM d y",
)
YEAR_FIRST_DAYS = ("y/M/d", "y.M.d")
TIMES = ("", " H:mm", " H:mm:ss", " h:mm[ ]a", " h:mm:ss[ ]a")
OTHER_LAYOUTS = (
    "y-M", "MMM y", "MMMM y", "M/d/yy", "d/M/yy", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssX",
    "d MMM y H:mm:ss xx", "y-M-d h:mm[ ]a", "y-M-d h:mm:ss[ ]a", "y-M-d h:mm:ss.SSS[ ]a",
    "y-M-d'T'H:mm:ssxx", "y-M-d H:mm:ssxx",
)
ISO_DATE = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
)
# Any date begins in one of these ways, so one test turns most other text away.
DATE_START = r"^[0-9]{1,8}[-/. T]|^[A-Za-z]{3}, [A-Za-z0-9]|^[A-Za-z]{3,9} [0-9]"
# A day of the week before a date says nothing more.
WEEKDAY_SHAPE = "b, "
WEEKDAY_LENGTH = 5
# No layout can match a longer text: the longest has a name of nine letters, a time to the
# nanosecond and an offset.
LONGEST_DATE_TEXT = 40
_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Shapes of the fields of a layout: a digit is 9, a letter a.
_FIELDS = {
    "y": ("9999",), "yy": ("99",), "yyyy": ("9999",), "M": ("9", "99"), "MM": ("99",),
    "MMM": ("aaa",), "MMMM": tuple("a" * n for n in range(4, 10)), "d": ("9", "99"),
    "dd": ("99",), "H": ("9", "99"), "HH": ("99",), "h": ("9", "99"), "mm": ("99",),
    "ss": ("99",), "SSS": ("999",), "a": ("aa",), "X": ("a",), "xx": ("+9999", "-9999"),
    "'T'": ("a",), "[ ]": ("", " "),
}


# Runs of the same kind in a shape, and what stands for them: years, other numbers, names.
_RUNS = (("9999", "y"), ("99?", "d"), ("aaaa+", "N"), ("aaa", "b"))


def shapes(layout: str) -> set[str]:
    """All shapes of text that a layout can read."""
    found = [""]
    for part in re.finditer(r"'T'|\[ \]|([A-Za-z])\1*|.", layout):
        found = [f + s for f in found for s in _FIELDS.get(part[0], (part[0],))]
    for run, sign in _RUNS:
        found = [re.sub(run, sign, f) for f in found]
    return set(found)


def _layouts() -> dict[str, list[str]]:
    """The layouts to try for each shape, in order."""
    out: dict[str, list[str]] = {}
    for layout in (*[d + t for d in (*YEAR_FIRST_DAYS, *NUMBERED_DAYS, *NAMED_DAYS)
                     for t in TIMES], *OTHER_LAYOUTS):
        for shape in shapes(layout):
            out.setdefault(shape, []).append(layout)
    return out


LAYOUTS_OF = _layouts()


def _choice(place: int) -> str:
    """A map from shapes to the layout to try at a place, as SQL."""
    pairs = [f"'{s}', '{found[place]}'" for s, found in LAYOUTS_OF.items() if len(found) > place]
    return "map(" + ", ".join(p.replace("'T'", "\\'T\\'") for p in pairs) + ")"


_CHOICES = [_choice(k) for k in range(max(map(len, LAYOUTS_OF.values())))]


def with_timestamp(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with text read as timestamp, NULL when no layout reads it.

    A text is prepared and folded to its shape once, in columns of their own; the shape tells
    the one or two layouts to try.
    """
    held = F.trim(c)
    folded = F.translate("_date", _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS))
    named = F.startswith(F.col("_shape"), F.lit(WEEKDAY_SHAPE))
    for run, sign in _RUNS:
        folded = F.regexp_replace(folded, run, sign)

    def bare(column: str, prefix: int) -> Column:
        return F.when(named, F.substring(column, prefix + 1, LONGEST_DATE_TEXT)).otherwise(
            F.col(column))

    text, shape = F.col("_date"), F.col("_shape")
    tried = F.coalesce(*[
        F.try_to_timestamp(text, F.try_element_at(F.expr(choice), shape)) for choice in _CHOICES])
    iso = F.startswith(shape, F.lit("y-d")) & text.rlike(ISO_DATE)
    return (
        df.withColumn("_date", F.when(
            (F.length(held) <= LONGEST_DATE_TEXT) & held.rlike(DATE_START), held))
        .withColumn("_shape", F.when(text.isNotNull(), folded))
        .withColumns({"_date": bare("_date", WEEKDAY_LENGTH),
                      "_shape": bare("_shape", len(WEEKDAY_SHAPE))})
        .withColumn(name, F.when(iso, text.try_cast("timestamp"))
                    .when(shape.isNotNull(), tried))
        .drop("_date", "_shape")
    )


def number_like(c: Column) -> Column:
    """True when the whole text reads as a number."""
    return c.rlike(NUMBER_LIKE)


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def value_text(field: T.StructField) -> Column:
    """A single value as display text; time values in ISO form."""
    c = P.col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def shown(c: Column, digits: int = 4) -> Column:
    """A number as fixed-point text for use in messages."""
    return F.format_string(f"%.{digits}f", c)
