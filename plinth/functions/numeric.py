"""Scalar functions: guarded arithmetic, coercion, rounding, text forms and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, otherwise: float | None = 0.0) -> Column:
    """num / den where den is positive, else ``otherwise``."""
    return F.when(_c(den) > 0, _c(num) / _c(den)).otherwise(F.lit(otherwise).cast("double"))


def try_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(_c(num), _c(den))


def absent_if_nan(c: str | Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(_c(c)), F.lit(None)).otherwise(_c(c))


def number(c: str | Column) -> Column:
    """Text or number as double, null where it is neither."""
    return absent_if_nan(_c(c).try_cast("double"))


def safe_int(c: str | Column) -> Column:
    """As a whole number, 0 where it is none."""
    return F.coalesce(number(c).try_cast("long"), F.lit(0))


def safe_float(c: str | Column) -> Column:
    """As a double, 0 where it is none."""
    return F.coalesce(number(c), F.lit(0.0))


def round_half_even(c: str | Column, digits: int) -> Column:
    return F.rint(_c(c) * 10**digits) / 10**digits


def format_int(c: str | Column) -> Column:
    """With spaces between thousands."""
    return F.replace(F.format_number(safe_int(c), 0), F.lit(","), F.lit(" "))


def format_float(c: str | Column, digits: int = 1) -> Column:
    """With spaces between thousands and a decimal comma."""
    return F.replace(F.replace(F.format_number(safe_float(c), digits), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))


def format_percent(part: str | Column, whole: str | Column, digits: int = 1) -> Column:
    """part of whole in percent; zero where whole isn't positive."""
    share = F.when(safe_float(whole) > 0, safe_float(part) / safe_float(whole) * 100).otherwise(0.0)
    return F.concat(format_float(share, digits), F.lit("%"))


def grid_key(x: str | Column, y: str | Column, size: float, nearest: bool = False) -> Column:
    """``gx_gy`` of the grid cell; null where a coordinate is. ``nearest`` rounds half to even instead of down."""
    step = F.rint if nearest else F.floor
    gx, gy = (step(_c(c) / F.lit(float(size))).cast("long").cast("string") for c in (x, y))
    return F.concat(gx, F.lit("_"), gy)


def _score(weights: dict[str, int], total: str) -> Column:
    """100 less each count's share of all rows times its weight, rounded half to even, within 0 and 100; 0 without rows."""
    penalty = sum((F.col(name) / F.col(total).cast("double") * w for name, w in weights.items()), F.lit(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(100 - penalty).cast("int")))
    return F.when(F.col(total) > 0, score).otherwise(F.lit(0))


def _label(score: str | Column, steps: dict[int, str], otherwise: str) -> Column:
    found = F.lit(otherwise)
    for least, name in sorted(steps.items()):
        found = F.when(_c(score) >= least, F.lit(name)).otherwise(found)
    return found


# Weights and labels of the two reports' scores.
QUALITY_WEIGHTS = {"rows_with_missing": 32, "invalid_geom": 32, "null_geom": 14, "empty_geom": 10, "signature_dups": 8, "invalid_holes": 4}
QUALITY_LABELS, QUALITY_WORST = {85: "Низкий риск", 70: "Умеренный риск", 50: "Повышенный риск"}, "Высокий риск"
VALIDATION_WEIGHTS = {
    "invalid_geom": 28, "empty_geom": 10, "zero_area": 10, "negative_area": 12, "filled_missing": 20,
    "flag_mismatch": 10, "observed_changed": 6, "predicted_with_original": 6, "above_500": 6,
}
VALIDATION_LABELS, VALIDATION_WORST = {95: "Данные согласованы", 85: "Низкий риск", 70: "Умеренный риск"}, "Нужна перепроверка"
#: Score of a target's reliability on the map, and the colour of each score.
RELIABILITY_SCORES = {"high": 3.0, "medium": 2.0, "low": 1.0, "none": 0.0}
SCORE_COLOURS, OTHER_COLOUR = {3.0: "#2c7bb6", 2.0: "#abd9e9", 1.0: "#fdae61", 0.5: "#ffffbf"}, "#d7191c"


def quality_score(total: str = "total") -> Column:
    """Score of a source from the counts named in QUALITY_WEIGHTS."""
    return _score(QUALITY_WEIGHTS, total)


def quality_label(score: str | Column) -> Column:
    return _label(score, QUALITY_LABELS, QUALITY_WORST)


def validation_score(total: str = "total") -> Column:
    """Score of the final table from the counts named in VALIDATION_WEIGHTS."""
    return _score(VALIDATION_WEIGHTS, total)


def validation_label(score: str | Column) -> Column:
    return _label(score, VALIDATION_LABELS, VALIDATION_WORST)


def score_colour(score: str | Column) -> Column:
    found = F.lit(OTHER_COLOUR)
    for value, colour in SCORE_COLOURS.items():
        found = F.when(_c(score) == value, colour).otherwise(found)
    return found




def confidence_score(reliability: str | Column, predicted: str | Column) -> Column:
    said = F.lit(0.0)
    for name, score in RELIABILITY_SCORES.items():
        said = F.when(_c(reliability) == name, F.lit(score)).otherwise(said)
    return F.when(_c(predicted) == 1, F.lit(0.5)).otherwise(said)
