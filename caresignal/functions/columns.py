"""Column expressions (all JVM-side built-ins; no Python UDF)."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    DEFAULT_NULL_TOKENS,
    MEASURE_CONDITIONS,
    SIGNAL_BAND_HIGH,
    SIGNAL_BAND_LOW,
)


def col_of(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def null_tokens(c: str | Column, tokens: Iterable[str] = DEFAULT_NULL_TOKENS) -> Column:
    """A text cell equal to one of the missing-value tokens becomes NULL (exact match)."""
    x = col_of(c)
    return F.when(x.isin(list(tokens)), F.lit(None).cast("string")).otherwise(x)


#: What counts as a number: decimal text, infinities and nan; none of the JVM's type suffixes.
NUMBER_TEXT = r"(?i)^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def is_number(c: str | Column) -> Column:
    return F.trim(col_of(c).cast("string")).rlike(NUMBER_TEXT)


def numeric_coerce(c: str | Column) -> Column:
    """Text -> double; anything that does not parse becomes NULL, never an error.

    NaN is mapped to NULL so that averages skip it like a missing value.
    """
    text = F.trim(col_of(c).cast("string"))
    parsed = F.when(is_number(c), text.try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def condition_name(measure: str | Column) -> Column:
    """Measure code -> clinical condition; unmapped codes give NULL."""
    pairs = []
    for code, name in MEASURE_CONDITIONS:
        pairs += [F.lit(code), F.lit(name)]
    return F.create_map(*pairs)[col_of(measure)]


def measure_code(index: Column) -> Column:
    """Measure index 0..5 -> measure code (fixture helper)."""
    return F.element_at(F.array(*[F.lit(c) for c, _ in MEASURE_CONDITIONS]), index + 1)


def parse_date(c: str | Column, formats: Sequence[str] = ("MM/dd/yyyy", "yyyy-MM-dd")) -> Column:
    """Strict date typing: the first format that parses wins; a non-null text that
    matches no format stops the job (the source code raises in this case)."""
    x = col_of(c)
    parsed = F.coalesce(*[F.try_to_date(x, f) for f in formats])
    return F.when(x.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit("unparseable date: "), x))).otherwise(parsed)


def err_class(err: str | Column) -> Column:
    """ERR interpretation: below / at / above 1; NULL stays NULL."""
    e = col_of(err)
    return (F.when(e < 1, F.lit("below_expected"))
            .when(e == 1, F.lit("as_expected"))
            .when(e > 1, F.lit("above_expected")))


def signal_band(mean_err: str | Column) -> Column:
    e = col_of(mean_err)
    return (F.when(e > SIGNAL_BAND_HIGH, F.lit("Elevated readmission signal"))
            .when(e < SIGNAL_BAND_LOW, F.lit("Lower readmission signal"))
            .when(e.isNotNull(), F.lit("Near expected")))


def confusion_label(y: str | Column, pred: str | Column) -> Column:
    y, p = col_of(y), col_of(pred)
    return (F.when((y == 1) & (p == 1), F.lit("TP"))
            .when((y == 0) & (p == 1), F.lit("FP"))
            .when((y == 0) & (p == 0), F.lit("TN"))
            .when((y == 1) & (p == 0), F.lit("FN")))


def threshold_flag(p: str | Column, threshold: float) -> Column:
    return F.when(col_of(p) >= F.lit(float(threshold)), F.lit("above")).otherwise(F.lit("below"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den as double, 0.0 when the denominator is zero."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def rnd(c: Column, digits: int) -> Column:
    """Round half-up on the decimal value; NULL stays NULL."""
    return F.round(c.cast("double"), digits)


def count_sorted_below(sorted_arr: Column, value: Column, length: int, inclusive: bool = False) -> Column:
    """Number of elements of an ascending array that are < value (<= if
    `inclusive`), by binary search unrolled into log2(length) codegen-friendly
    steps (no per-row lambda)."""
    pos = F.lit(0)
    step = 1
    while step * 2 <= length:
        step *= 2
    while step >= 1:
        probe = F.try_element_at(sorted_arr, pos + F.lit(step))
        ok = (probe <= value) if inclusive else (probe < value)
        pos = pos + F.when(F.coalesce(ok, F.lit(False)), F.lit(step)).otherwise(F.lit(0))
        step //= 2
    return pos
