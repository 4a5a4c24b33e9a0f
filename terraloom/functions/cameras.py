"""Rational polynomial cameras and the spread of triangulated points."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The terms of normalised longitude x, latitude y and height z that the twenty coefficients belong to, in their order.
TERMS = ["", "x", "y", "z", "xy", "xz", "yz", "xx", "yy", "zz", "xyz", "xxx", "xyy", "xzz", "xxy", "yyy", "yzz", "xxz", "yyz", "zzz"]


@dataclass(frozen=True)
class RationalCamera:
    """Coefficients in the order of TERMS; offsets and scales of longitude, latitude and height, and of sample and line."""

    sample: tuple[list[float], list[float]]
    line: tuple[list[float], list[float]]
    ground_offset: tuple[float, float, float]
    ground_scale: tuple[float, float, float]
    pixel_offset: tuple[float, float]
    pixel_scale: tuple[float, float]


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _terms(place: dict, one):
    return [math.prod((place[c] for c in term), start=one) for term in TERMS]


def rational_pixel(lon: Column, lat: Column, height: Column, camera: RationalCamera) -> tuple[Column, Column]:
    """Sample and line of a ground point: for each the quotient of two polynomials, scaled; null where a divisor is 0."""
    g = [(c - o) / s for c, o, s in zip((lon, lat, height), camera.ground_offset, camera.ground_scale, strict=True)]
    terms = _terms(dict(zip("xyz", g, strict=True)), F.lit(1.0))
    poly = lambda cs: sum((F.lit(float(c)) * t for c, t in zip(cs, terms, strict=True) if c), F.lit(0.0))
    out = [F.try_divide(poly(up), poly(down)) * s + o for (up, down), s, o in zip((camera.sample, camera.line), camera.pixel_scale, camera.pixel_offset, strict=True)]
    return out[0], out[1]


def rational_ground(sample: Column, line: Column, height: Column, camera: RationalCamera, rounds: int = 20) -> Column:
    """struct(lon, lat) that the camera sees at a pixel at a height, by Newton steps from its middle; null without convergence."""
    offset, scale = camera.ground_offset, camera.ground_scale

    @F.pandas_udf(_doubles("lon", "lat"))
    def solve(s: pd.Series, n: pd.Series, h: pd.Series) -> pd.DataFrame:
        wanted = [(c.to_numpy(float) - o) / k for c, o, k in zip((s, n), camera.pixel_offset, camera.pixel_scale, strict=True)]
        z = (h.to_numpy(float) - offset[2]) / scale[2]
        x, y = np.zeros(len(z)), np.zeros(len(z))
        for _ in range(rounds):
            place, one = {"x": x, "y": y, "z": z}, np.ones(len(z))
            terms = _terms(place, one)
            slopes = {c: [t.count(c) * math.prod((place[a] for a in t.replace(c, "", 1)), start=one) if c in t else 0 * one for t in TERMS] for c in "xy"}
            miss, jac = [], []
            for (up, down), w in zip((camera.sample, camera.line), wanted, strict=True):
                total = lambda cs, ts: sum(c * t for c, t in zip(cs, ts, strict=True))
                a, b = total(up, terms), total(down, terms)
                miss.append(w - a / b)
                jac.append([(total(up, slopes[c]) * b - a * total(down, slopes[c])) / (b * b) for c in "xy"])
            (p, q), (r, t) = jac
            det = p * t - q * r
            dx, dy = (miss[0] * t - q * miss[1]) / det, (p * miss[1] - r * miss[0]) / det
            x, y = x + dx, y + dy
        good = np.isfinite(x) & np.isfinite(y) & (np.abs(dx) + np.abs(dy) < 1e-9)
        return pd.DataFrame({"lon": np.where(good, x * scale[0] + offset[0], np.nan), "lat": np.where(good, y * scale[1] + offset[1], np.nan)})

    found = solve(sample.cast("double"), line.cast("double"), height.cast("double"))
    whole = lambda c: F.when(~F.isnan(c), c)
    return F.struct(whole(found["lon"]).alias("lon"), whole(found["lat"]).alias("lat"))


def _midpoint(c1, d1, c2, d2):
    n1, n2 = np.cross(d1, np.cross(d2, d1)), np.cross(d2, np.cross(d1, d2))
    along = lambda c, d, o, n: c + d * (((o - c) * n).sum(1) / (d * n).sum(1))[:, None]
    return (along(c1, d1, c2, n2) + along(c2, d2, c1, n1)) / 2


@F.pandas_udf(_doubles("horizontal", "vertical"))
def triangulation_spread(centre1: pd.Series, ray1: pd.Series, centre2: pd.Series, ray2: pd.Series, deviation1: pd.Series, deviation2: pd.Series) -> pd.DataFrame:
    """Standard deviations of a point triangulated from two rays, from those of where the rays meet its horizontal plane.

    Centres and rays are arrays of north, east and down from the point. The covariance goes through centred differences
    of a centimetre; horizontal is the fourth root of the determinant of its north-east part, vertical the root of its
    last entry. Null where a component is null or rays are level or parallel.
    """
    stack = lambda s: np.array([v if v is not None and len(v) == 3 else [np.nan] * 3 for v in s], float).reshape(-1, 3)
    with np.errstate(all="ignore"):
        centres = [stack(centre1), stack(centre2)]
        hits = [c - r * (c[:, 2:] / r[:, 2:]) for c, r in zip(centres, (stack(ray1), stack(ray2)), strict=True)]
        delta, jac = 0.01, []
        for camera in (0, 1):
            for axis in (0, 1):
                ends = []
                for sign in (1, -1):
                    moved = [h.copy() for h in hits]
                    moved[camera][:, axis] += sign * delta
                    rays = [(m - c) / np.linalg.norm(m - c, axis=1)[:, None] for m, c in zip(moved, centres, strict=True)]
                    ends.append(_midpoint(centres[0], rays[0], centres[1], rays[1]))
                jac.append((ends[0] - ends[1]) / (2 * delta))
        jac = np.stack(jac, axis=2)
        variance = np.stack([d.to_numpy(float) ** 2 for d in (deviation1, deviation1, deviation2, deviation2)], axis=1)
        p = np.einsum("nij,nj,nkj->nik", jac, variance, jac)
        flat = p[:, 0, 0] * p[:, 1, 1] - p[:, 0, 1] * p[:, 1, 0]
        out = pd.DataFrame({"horizontal": np.sqrt(np.sqrt(flat)), "vertical": np.sqrt(p[:, 2, 2])})
    return out.astype(object).where(np.isfinite(out.to_numpy(float)), None)
