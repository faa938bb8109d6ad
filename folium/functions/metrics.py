"""Native expressions for precision, recall, F scores, shares and page geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 for a zero denominator."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1_score, f05_score and f15_score of counts."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1_score": f_beta(p, r, 1.0), "f05_score": f_beta(p, r, 0.5), "f15_score": f_beta(p, r, 1.5)}


def share(part: Column, whole: Column) -> Column:
    """Percentage; null of nothing."""
    return F.when(whole > 0, part.cast("double") * 100 / whole)


def image_scale(width: Column, height: Column, most_side: float = 2000, most_pixels: float = 3.5e6) -> Column:
    """Factor, at most 1, that brings an image within a side and a number of pixels."""
    return F.least(F.lit(1.0), F.lit(most_side) / F.greatest(width, height), F.sqrt(F.lit(most_pixels) / (width * height)))


def render_zoom(width: Column, height: Column, dpi: float, most_pixels: float) -> Column:
    """Zoom of a page of points for a resolution, lowered if it would have too many pixels."""
    zoom = F.lit(dpi / 72.0)
    pixels = width * height * zoom * zoom
    return F.when(pixels > most_pixels, zoom * F.sqrt(F.lit(most_pixels) / pixels)).otherwise(zoom)


def retry_temperature(attempt: Column, first: float, step: float) -> Column:
    return F.lit(first) + attempt * F.lit(step)


def fixed(digits: int, missing: str = ""):
    """A text sink's number format, rounded half to even as in C; null gives `missing`."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return pd.Series([missing if pd.isna(x) else f"{x:.{digits}f}" for x in s], dtype=object)

    return show


def percent_text(part: Column, whole: Column) -> Column:
    """Percentage with two decimals for a text sink, or N/A."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return pd.Series(["N/A" if pd.isna(x) else f"{x:.2f}%" for x in s], dtype=object)

    return show(share(part, whole))
