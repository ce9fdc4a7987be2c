"""Scalar expressions over columns: weights, tails of distributions, distances and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def no_nan(x: Column) -> Column:
    """NaN as null: missing values are null everywhere in this library."""
    return F.nanvl(x, F.lit(None).cast("double"))


def quantised(x: Column, scale: float = 100.0) -> Column:
    """Fixed point in 16 bits, clipped; null as -32768."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-32767), F.least(F.lit(32767), F.round(x * scale)))).otherwise(-32768).cast("short")


def dequantised(x: Column, scale: float = 100.0) -> Column:
    return F.when(x != -32768, x / scale)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution by a published polynomial (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    # fixed values of the polynomial
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * poly * F.exp(-a * a / 2) * 0.3989422804014327


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, at_lat: float = 25.0, per_degree: float = 111.2) -> Column:
    return F.hypot((lon1 - lon2) * F.cos(F.radians(F.lit(at_lat))), lat1 - lat2) * per_degree


def water_mass(t: Column, s: Column) -> Column:
    """Class of a water sample; the order of the rules matters. Null where either is null."""
    missing = t.isNull() | s.isNull()
    return F.when(missing, None).when(s < 34, "coastal").when((s >= 34.6) & (t < 22), "subsurface").when(s >= 34.6, "surface").otherwise("shelf")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def _named(then, **columns: Column) -> Column:
    """then(row) over the columns computed once, as a row."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])), then)[0]


def student_two_sided(t: Column, df: Column, rounds: int = 200) -> Column:
    """Two-sided tail of Student's t of df degrees of freedom (not only whole ones), by the incomplete beta function's continued fraction."""
    far = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def fraction(r: Column) -> Column:
        p, q, z = r["p"], r["q"], r["z"]
        first = 1 / far(1 - (p + q) * z / (p + 1))

        def step(s: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            by = F.when(k % 2 == 0, m * (q - m) * z / ((p - 1 + 2 * m) * (p + 2 * m))).otherwise(-(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 1 + 2 * m)))
            c, d = far(1 + by / s["c"]), 1 / far(1 + by * s["d"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        total = r["front"] * F.aggregate(F.sequence(F.lit(2), F.lit(2 * rounds + 1)), start, step, lambda s: s["h"]) / p
        return F.when(r["swap"], 1 - total).otherwise(total)

    def tail(r: Column) -> Column:
        a, x = r["a"], r["x"]
        # gamma(a + 1/2) / gamma(a): its series at a + 10, and ten steps down
        high = a + 10
        gammas = F.sqrt(high) * (1 - 1 / (8 * high) + 1 / (128 * high**2) + 5 / (1024 * high**3) - 21 / (32768 * high**4))
        gammas = F.aggregate(F.sequence(F.lit(0), F.lit(9)), gammas, lambda g, k: g * (a + k) / (a + k + 0.5))
        swap = x >= (a + 1) / (a + 2.5)
        half = F.lit(0.5)
        return _named(fraction, swap=swap, p=F.when(swap, half).otherwise(a), q=F.when(swap, a).otherwise(half), z=F.when(swap, 1 - x).otherwise(x), front=F.pow(x, a) * F.sqrt(1 - x) * gammas / 1.772453850905516)

    whole = _named(lambda r: _named(tail, a=r["df"] / 2, x=r["df"] / (r["df"] + r["t"] * r["t"])), t=t.cast("double"), df=df.cast("double"))
    return F.when(t == 0, 1.0).otherwise(whole)


def eddy_energy(su: Column, sv: Column) -> Column:
    return 0.5 * (su * su + sv * sv)


def shear(u0: Column, v0: Column, u1: Column, v1: Column, dz: Column) -> Column:
    """Per 1000 units of depth, where the levels lie 20 or more apart."""
    return F.when(dz >= 20, F.hypot(u1 - u0, v1 - v0) / F.greatest(dz, F.lit(10.0)) * 1000)


def rescaled(v: Column, when: Column) -> Column:
    """Values read with the wrong palette, on the rows marked."""
    return F.when(when, (v + 2) * 37 / 32 - 2).otherwise(v)


def decoded_bytes(q: Column, add: float, by: float) -> Column:
    """One byte of fixed point: add + q / by; 255 is missing."""
    return F.when(q != 255, add + q / by)


def ramp(x: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Red, green and blue at x from 0 to 1 (beyond: the end's) along colours of equal distances, as whole numbers, halves up."""
    last = len(stops) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * last
    k = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    channel = lambda c: F.array(*[F.lit(float(s[c])) for s in stops])
    return [F.floor(F.get(channel(c), k) + (F.get(channel(c), k + 1) - F.get(channel(c), k)) * (at - k) + 0.5).cast("int") for c in range(3)]


def nearest_colour(rgb: list[Column], palette: list[tuple[int, int, int]], near: float = 18.0, saturation: int = 100) -> Column:
    """Index of the palette's nearest colour, the first of equally near ones; null where none is near or the colour is dull."""
    d = [sum(((a - b) * (a - b) for a, b in zip(rgb, p)), F.lit(0)) for p in palette]
    best = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(k).alias("k")) for k, x in enumerate(d)]))
    return F.when((best["d"] < near * near) & (F.greatest(*rgb) - F.least(*rgb) > saturation), best["k"])
