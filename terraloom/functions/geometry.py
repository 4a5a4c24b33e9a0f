"""Scalar functions on points, angles, times and colours, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-axes of the WGS84 ellipsoid in metres.
WGS84 = (6378137.0, 6356752.314245179)


def cartesian(lon: Column, lat: Column, height: Column, axes: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z of degrees and metres above an ellipsoid."""
    a, b = axes
    flat = (b / a) ** 2
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - (1 - flat) * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (flat * n + height) * F.sin(phi)


def recentred(lon: Column, centre: float) -> Column:
    """A longitude shifted by whole turns to within half a turn of the centre."""
    return lon - 360 * F.round((lon - centre) / 360)


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two vectors; null if one is zero."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    size = F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0])) * F.sqrt(sum((y * y for y in b[1:]), b[0] * b[0]))
    cosine = F.try_divide(dot, size)
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def snapped(value: Column, step: float) -> Column:
    """Rounded to a multiple of the step; null stays null."""
    return F.round(value / step) * step


def north_east_down(dx: Column, dy: Column, dz: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """An earth-centred offset as seen at a place."""
    phi, lam = F.radians(lat), F.radians(lon)
    east = -F.sin(lam) * dx + F.cos(lam) * dy
    outward = F.cos(lam) * dx + F.sin(lam) * dy
    return -F.sin(phi) * outward + F.cos(phi) * dz, east, -(F.cos(phi) * outward + F.sin(phi) * dz)


def line_of_time(t: Column, start: float, step: float) -> Column:
    return (t - start) / step


def time_of_line(line: Column, start: float, step: float) -> Column:
    return line * step + start


def seconds_since_2000(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - 946684800000000) / 1e6


def jitter(distance: Column, waves: list[tuple[float, float, float]]) -> Column:
    """Sum of amplitude * sin(2 pi distance / period + phase)."""
    out = F.lit(0.0)
    for amplitude, period, phase in waves:
        out = out + amplitude * F.sin(2 * F.pi() * distance / period + phase)
    return out


def plateau(weight: Column, most: float, power: float) -> Column:
    """A weight clamped to 0..most, as a share of it, raised to a power."""
    return F.pow(F.greatest(F.lit(0.0), F.least(weight, F.lit(float(most)))) / most, power)


def lambertian(normal: list[Column], sun: list[Column]) -> Column:
    """Reflectance: the cosine between normal and sun, 0 where the sun is below."""
    cosine = F.cos(F.radians(angle_between(normal, sun)))
    return F.when(cosine.isNotNull(), F.greatest(F.lit(0.0), cosine))


def geodetic(x: Column, y: Column, z: Column, axes: tuple[float, float] = WGS84, rounds: int = 5) -> tuple[Column, Column, Column]:
    """lon, lat (degrees) and height of earth-centred coordinates, by fixed-point steps on the latitude (below a millimetre near the surface)."""
    a, b = axes
    e2 = 1 - (b / a) ** 2
    p = F.sqrt(x * x + y * y)
    phi = F.atan2(z, p * (1 - e2))
    for _ in range(rounds):
        n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
        phi = F.atan2(z + e2 * n * F.sin(phi), p)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    height = F.cos(phi) * p + F.sin(phi) * z - a * a / n
    return F.degrees(F.atan2(y, x)), F.degrees(phi), height


def shifted(point: list[Column], offset: list[float]) -> list[Column]:
    return [p - F.lit(float(o)) for p, o in zip(point, offset, strict=True)]


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def affine(point: list[Column], matrix: list[list[float]], shift: list[float]) -> list[Column]:
    """matrix * point + shift; a point at the origin marks no data and stays there."""
    zero = (point[0] == 0) & (point[1] == 0) & (point[2] == 0)
    return [F.when(zero, F.lit(0.0)).otherwise(sum((F.lit(float(m)) * p for m, p in zip(row[1:], point[1:], strict=True)), F.lit(float(row[0])) * point[0]) + F.lit(float(t))) for row, t in zip(matrix, shift, strict=True)]


def erf_step(x: Column, most: float, steep: float) -> Column:
    """A smooth step from 0 at 0 to `most` at `most`; the error function by a rational approximation, within 2e-7."""
    t = F.lit(0.5 * 3.141592653589793**0.5) * (2 * x * steep / most - steep)
    u = 1 / (1 + 0.3275911 * F.abs(t))
    # Coefficients of Abramowitz and Stegun 7.1.26.
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    erf = F.signum(t) * (1 - poly * F.exp(-t * t))
    return F.when(x <= 0, 0.0).when(x >= most, float(most)).otherwise(0.5 * most * (1 + erf))


def wrapped(lon: Column, lat: Column) -> tuple[Column, Column]:
    """A place beyond a pole as lon in [0, 360) and lat in [-90, 90]: over the pole it goes on along the opposite meridian."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    return F.pmod(lon + F.when(turn > 180, 180.0).otherwise(0.0), F.lit(360.0)), F.when(turn > 180, 270 - turn).otherwise(turn - 90)


def geoid_adjusted(height: Column, geoid: Column, correction: float = 0.0, reverse: bool = False) -> Column:
    """Height above the geoid of one above the ellipsoid, or, reverse, the other way."""
    return height + (geoid + correction) if reverse else height - (geoid + correction)


# What stands for no data in each pixel type.
NODATA = {"int32": -2147483648.0, "int16": -32768.0, "uint8": 0.0, "uint16": 0.0, "uint32": 0.0}


def nodata_of(kind: Column) -> Column:
    """The no-data value of a pixel type's name; types of floating point and others have -1e6."""
    out = F.lit(-1e6)
    for name, value in NODATA.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def timestamp_text(text: Column) -> Column:
    """A time stamp's text with exactly six digits after its point; a last character that is no digit stays behind them."""
    digits = F.regexp_extract(text, r"\.(\d*)", 1)
    tail = F.regexp_extract(text, r"\.\d*(\D?)$", 1)
    return F.when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(F.substring(digits, 1, 6), 6, "0"), tail)).otherwise(text)


def parsed_timestamp(text: Column) -> Column:
    """The time of a stamp such as 2003-02-01T04:05:06.7Z, to the microsecond; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(timestamp_text(text), "T", " "), r"\D$", "")
    return plain.try_cast("timestamp_ntz")


def norm_difference(dx: Column, dy: Column, dx2: Column, dy2: Column) -> Column:
    """Length of one disparity less that of another."""
    return F.sqrt(dx * dx + dy * dy) - F.sqrt(dx2 * dx2 + dy2 * dy2)


def rgb_to_ycbcr(r: Column, g: Column, b: Column, lo: float = 0.0, hi: float = 255.0) -> tuple[Column, Column, Column]:
    """Luma and two colour differences, kept between lo and hi."""
    mid = (lo + hi + 1) / 2
    parts = (0.299 * r + 0.587 * g + 0.114 * b, mid - 0.168736 * r - 0.331264 * g + 0.5 * b, mid + 0.5 * r - 0.418688 * g - 0.081312 * b)
    return tuple(F.least(F.greatest(p, F.lit(lo)), F.lit(hi)) for p in parts)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, lo: float = 0.0, hi: float = 255.0) -> tuple[Column, Column, Column]:
    mid = (lo + hi + 1) / 2
    parts = (y + 1.402 * (cr - mid), y - 0.34414 * (cb - mid) - 0.71414 * (cr - mid), y + 1.772 * (cb - mid))
    return tuple(F.least(F.greatest(p, F.lit(lo)), F.lit(hi)) for p in parts)


def _cosines(normal: list[Column], sun: list[Column], view: list[Column]) -> tuple[Column, Column, Column]:
    """Cosines of sun and normal, of view and normal, of sun and view."""
    unit = lambda v: [F.try_divide(x, norm(v)) for x in v]
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    n, s, v = unit(normal), unit(sun), unit(view)
    return dot(s, n), dot(v, n), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(s, v)))


def lunar_lambertian(normal: list[Column], sun: list[Column], view: list[Column], coefficients: tuple[float, float, float, float] = (1.0, -0.019, 0.000242, -0.00000146), c1: float = 0.0, c2: float = 0.0) -> Column:
    """Reflectance between the lunar and Lambert's law by a cubic of the phase angle in degrees; 0 where it can't be formed."""
    mu0, mu, cos_phase = _cosines(normal, sun, view)
    phase = F.acos(cos_phase)
    deg = F.degrees(phase)
    share = sum((F.lit(c) * F.pow(deg, k) for k, c in enumerate(coefficients) if k), F.lit(coefficients[0]))
    return F.coalesce((F.try_divide(2 * share * mu0, mu0 + mu) + (1 - share) * mu0) * (F.exp(-c1 * phase) + c2), F.lit(0.0))


def hapke(normal: list[Column], sun: list[Column], view: list[Column], omega: float, b: float, c: float, b0: float, h: float) -> Column:
    """Hapke's reflectance with a double Henyey-Greenstein phase function and an opposition term."""
    mu0, mu, cos_g = _cosines(normal, sun, view)
    phase = (1 - c) * (1 - b * b) / F.pow(1 + 2 * b * cos_g + b * b, 1.5) + c * (1 - b * b) / F.pow(1 - 2 * b * cos_g + b * b, 1.5)
    opposition = b0 / (1 + F.tan(F.acos(cos_g) / 2) / h)
    bright = lambda m: (1 + 2 * m) / (1 + 2 * m * (1 - omega) ** 0.5)
    return omega / 4 / F.pi() * F.try_divide(mu0, mu0 + mu) * ((1 + opposition) * phase + bright(mu0) * bright(mu) - 1)


def charon(normal: list[Column], sun: list[Column], view: list[Column], albedo: float = 0.7, phase: float = 0.63) -> Column:
    mu0, mu, _ = _cosines(normal, sun, view)
    return phase * albedo * F.try_divide(mu0, mu0 + mu) + (1 - albedo) * mu0


def sun_angles(north: Column, east: Column, down: Column) -> tuple[Column, Column]:
    """Azimuth (0 where the sun is at the zenith) and elevation in degrees of a direction north, east, down."""
    level = (north == 0) & (east == 0)
    return F.when(level, 0.0).otherwise(F.degrees(F.atan2(east, north))), F.degrees(F.atan2(-down, F.sqrt(north * north + east * east)))


def sun_direction(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """North, east, down of an azimuth and an elevation in degrees."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.cos(a) * F.cos(e), F.sin(a) * F.cos(e), -F.sin(e)


def same_hemisphere(q: list[Column], ref: list[Column]) -> list[Column]:
    """The quaternion, or its opposite, which is the same rotation, that is nearer to ref; normalised."""
    dot = sum((a * b for a, b in zip(q[1:], ref[1:], strict=True)), q[0] * ref[0])
    return [F.try_divide(F.when(dot < 0, -x).otherwise(x), norm(q)) for x in q]


def slerp(a: list[Column], b: list[Column], share: Column) -> list[Column]:
    """The rotation a share of the way from a to b, both unit quaternions; nearly equal ones are mixed linearly."""
    b = same_hemisphere(b, a)
    dot = F.least(sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0]), F.lit(1.0))
    angle = F.acos(dot)
    near = angle < 1e-6
    wa = F.when(near, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    wb = F.when(near, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
    return [wa * x + wb * y for x, y in zip(a, b, strict=True)]


def roll_pitch_yaw(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Degrees about x, y and z, in that order, of a unit quaternion."""
    pitch = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(F.asin(pitch)), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def snapped_box(x0: Column, y0: Column, x1: Column, y1: Column, step: float, percent: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """A box grown by a percentage of its size, half at each end, then outwards to multiples of the step."""
    gx, gy = (x1 - x0) * percent / 200, (y1 - y0) * percent / 200
    return F.floor((x0 - gx) / step) * step, F.floor((y0 - gy) / step) * step, F.ceil((x1 + gx) / step) * step, F.ceil((y1 + gy) / step) * step


def numbers_in_parentheses(text: Column) -> Column:
    """An array of arrays: the numbers of each group in parentheses."""
    groups = F.regexp_extract_all(text, F.lit(r"\(([ \d.,-]*)\)"), F.lit(1))
    return F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).try_cast("double")))


def tile_name(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.concat_ws("_", F.lit("tile"), *(c.cast("string") for c in (x0, y0, x1, y1)))


def tile_of_name(name: Column) -> list[Column]:
    """The last four numbers of a tile's name, an ending left out."""
    return [F.regexp_extract(name, r"(-?\d+)_(-?\d+)_(-?\d+)_(-?\d+)(?:\.\w+)?$", i).try_cast("long") for i in (1, 2, 3, 4)]


def segment_count(length: Column, size: int) -> Column:
    """Number of pieces of nearly equal length, at most `size`, that make up a length; one at least."""
    return F.ceil(F.greatest(length, F.lit(1)) / size)


def segment_border(length: Column, size: int, k: Column) -> Column:
    """Border k (from 0) of these pieces: their first `big` ones are one longer than the others."""
    n, pieces = F.greatest(length, F.lit(1)), segment_count(length, size)
    small = F.floor(n / pieces)
    return k * small + F.least(k, n - small * pieces)


def segments(length: Column, size: int) -> Column:
    """Borders of pieces of nearly equal length, at most `size`, that make up a length: an array from 0 to the length."""
    return F.transform(F.sequence(F.lit(0).cast("long"), segment_count(length, size)), lambda k: segment_border(length, size, k))


def refraction_index(wavelength_nm: Column, celsius: Column, salinity: Column) -> Column:
    """Index of sea water against vacuum, from wavelength, temperature and salinity (parts per thousand)."""
    # Coefficients n0 .. n9 of Quan and Fry (1995).
    n = (1.31405, 1.779e-4, -1.05e-6, 1.6e-8, -2.02e-6, 15.868, 0.01155, -0.00423, -4382.0, 1.1455e6)
    t, s, w = celsius, salinity, wavelength_nm
    return n[0] + (n[1] + n[2] * t + n[3] * t * t) * s + n[4] * t * t + (n[5] + n[6] * s + n[7] * t) / w + n[8] / (w * w) + n[9] / (w * w * w)


def refraction_index_by_salinity(wavelength_nm: Column, celsius: Column, salinity: Column) -> Column:
    """Index of water from quadratics in temperature and wavelength, for fresh water and for 35 parts per thousand of salt, drawn linearly by salinity."""
    # Coefficients of Parrish (2020) for T^2, lambda^2, T, lambda and 1.
    fresh = (-1.97812e-6, 1.03223e-7, -8.58125e-6, -1.54834e-4, 1.38919)
    sea = (-1.50156e-6, 1.07085e-7, -4.27594e-5, -1.60476e-4, 1.39807)
    a, b, c, d, e = (f + salinity / 35.0 * (s - f) for f, s in zip(fresh, sea, strict=True))
    return a * celsius * celsius + b * wavelength_nm * wavelength_nm + c * celsius + d * wavelength_nm + e


def effective_wavelength(wavelength_nm: Column, response: Column, least: float, most: float) -> dict[str, Column]:
    """Aggregates over a spectral response: its weighted mean wavelength, and that of the largest response (the smaller one on ties).

    Wavelengths outside [least, most] and responses that aren't positive are left out.
    """
    counts = (response > 0) & wavelength_nm.between(least, most)
    w, r = F.when(counts, wavelength_nm), F.when(counts, response)
    return {"weighted_mean": F.try_divide(F.sum(w * r), F.sum(r)), "peak_response": -F.max(F.struct(r.alias("r"), (-w).alias("w")))["w"]}


def parabola_offset(before: Column, at: Column, after: Column) -> Column:
    """Where a parabola through three neighbouring costs has its extremum, as an offset from the middle; 0 where it is flat."""
    return F.coalesce(F.try_divide(before - after, 2 * (before - 2 * at + after)), F.lit(0.0))


def ray_midpoint(c1: list[Column], d1: list[Column], c2: list[Column], d2: list[Column]) -> tuple[list[Column], Column]:
    """The point half-way between two rays (centre, direction) where they are nearest, and their distance; null for parallel rays."""
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    w = [a - b for a, b in zip(c1, c2, strict=True)]
    a, b, c, d, e = dot(d1, d1), dot(d1, d2), dot(d2, d2), dot(d1, w), dot(d2, w)
    det = a * c - b * b
    s, t = F.try_divide(b * e - c * d, det), F.try_divide(a * e - b * d, det)
    p, q = [x + s * y for x, y in zip(c1, d1, strict=True)], [x + t * y for x, y in zip(c2, d2, strict=True)]
    return [(x + y) / 2 for x, y in zip(p, q, strict=True)], norm([x - y for x, y in zip(p, q, strict=True)])


def refract(centre: list[Column], direction: list[Column], normal: tuple[float, float, float], offset: float, index: float) -> tuple[list[Column], list[Column]]:
    """(where a ray meets the plane normal . p = offset, its unit direction beyond it); index is that beyond the plane over that before it.

    The normal points to the side that the ray comes from. Null for rays along the plane and where all light is reflected.
    """
    size = F.sqrt(sum((c * c for c in normal[1:]), normal[0] * normal[0]) + F.lit(0.0))
    n = [F.lit(float(c)) / size for c in normal]
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    length = norm(direction)
    d = [F.try_divide(c, length) for c in direction]
    along = dot(n, d)
    t = F.try_divide(F.lit(float(offset)) / size - dot(n, centre), along)
    ratio = 1.0 / index
    inside = 1 - ratio * ratio * (1 - along * along)
    bend = F.when(inside >= 0, -ratio * along - F.sqrt(inside))
    return [c + t * x for c, x in zip(centre, d, strict=True)], [ratio * x + bend * y for x, y in zip(d, n, strict=True)]
