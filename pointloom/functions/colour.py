"""Colours of points as columns: by scan, by height, by distance, by intensity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ten colours that scans take in the order of their import, by the public Tableau 10 palette.
SCAN_COLOURS = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")

# Coefficients of the public polynomial fit of the Turbo colour map, of rising powers.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def by_scan(order: Column) -> Column:
    """The colour of a scan by its place in the order."""
    return F.element_at(F.array(*map(F.lit, SCAN_COLOURS)), (F.pmod(order, F.lit(len(SCAN_COLOURS))) + 1).cast("int"))


def turbo(share: Column) -> Column:
    """Struct of red, green and blue (0 to 1) of a share of the range, which is clamped."""
    t = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    out = []
    for name, row in zip(("r", "g", "b"), TURBO, strict=True):
        v = F.lit(row[-1])
        for c in reversed(row[:-1]):
            v = v * t + c
        out.append(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(name))
    return F.struct(*out)


def by_height(z: Column, low: Column, high: Column) -> Column:
    """By the share of a height between two percentiles; the lowest colour where they are equal."""
    return turbo(F.when(high > low, (z - low) / (high - low)).otherwise(0.0))


def shade(depths: list[Column], own: Column, strength: float) -> Column:
    """How much light a pixel keeps (0 to 1): less, the nearer its neighbours are, by differences of logarithms."""
    total = F.lit(0.0)
    for d in depths:
        total = total + F.greatest(F.log2(own) - F.log2(d), F.lit(0.0))
    return F.exp(-total / len(depths) * 300 * strength)
