"""Confidence, frame and length scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


# fixed values: the weights, scales and bounds of the scores below


def point_confidence(observations: Column, view: Column, sharpness: Column, gps: Column, residual: Column) -> Column:
    one = F.lit(1.0)
    raw = 0.28 * F.least(observations / 6, one) + 0.22 * F.least(view, one) + 0.18 * F.least(sharpness, one) + 0.18 * gps + 0.14 * clip(1 - residual / 4, 0.0, 1.0)
    return clip(raw, 0.05, 0.98)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.72, "high").when(confidence >= 0.42, "medium").otherwise("low")


def uncertainty(confidence: Column) -> Column:
    return clip(1 / F.greatest(confidence, F.lit(0.05)), 0.05, 20.0)


def frame_score(sharpness: Column, features: Column, texture: Column, exposure: Column, redundancy: Column) -> Column:
    one = F.lit(1.0)
    return 0.35 * F.least(sharpness / 120, one) + 0.3 * F.least(features / 250, one) + 0.15 * F.least(texture / 5, one) + 0.1 * exposure + 0.1 * (1 - redundancy)


def evaluate_length(measured: Column, true: Column, tolerance: Column, percent: Column) -> dict[str, Column]:
    """Error of a measured length, and whether it is within max(percent of the length, tolerance; 1 m
    if that is null)."""
    error, allowed = F.abs(measured - true), F.greatest(F.abs(true) * percent / 100, F.coalesce(tolerance, F.lit(1.0)))
    return {
        "measured_m": F.round(measured, 3),
        "abs_error_m": F.round(error, 3),
        "pct_error": F.when(true == 0, F.lit(0.0)).otherwise(F.round(error / F.nullif(F.abs(true), F.lit(0.0)) * 100, 2)),
        "tolerance_m": F.round(allowed, 3),
        "pass": error <= allowed,
    }


def measure(measured: Column, true: Column, tolerance: Column, percent: Column) -> dict[str, Column]:
    """The same for a request: without a positive true length only the measured one is told, and a
    percentage of 0 counts as 5."""
    known = F.coalesce(true > 0, F.lit(False))
    out = evaluate_length(measured, F.when(known, true), tolerance, F.coalesce(F.when(percent != 0, percent), F.lit(5.0)))
    return {k: c if k == "measured_m" else F.when(known, c) for k, c in out.items()}


def building_height(height: Column, levels: Column, kind: Column, tall: tuple[str, ...]) -> Column:
    """From an explicit height (its first token), else 3.1 m a level (the first of a list), else 16 or 9
    by kind; explicit ones between 4 and 140."""
    explicit = F.split(F.trim(height), " ")[0].try_cast("double")
    storeys = F.split(levels, ";")[0].try_cast("double") * 3.1
    known = F.coalesce(explicit, storeys)
    # bounds of a null would be 4
    return F.when(known.isNotNull(), clip(known, 4.0, 140.0)).when(kind.isin(*tall), 16.0).otherwise(9.0)
