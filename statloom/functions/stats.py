"""Small statistical column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pair_corr(x, y) -> Column:
    """Correlation over rows where both sides exist; NULL (not an error) when a side does not vary."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def safe_rate(x, y) -> Column:
    """x / y where y > 0, else NULL."""
    return F.when(_c(y) > 0, _c(x) / _c(y))


def floor_zero(x) -> Column:
    return F.greatest(_c(x), F.lit(0))


def half_even(x, places: int = 0) -> Column:
    return F.bround(_c(x), places)


def half_away(x, places: int = 1) -> Column:
    return F.round(_c(x), places)


def half_up(x, places: int = 0) -> Column:
    """Rounds .5 towards +infinity, as browsers do."""
    scale = 10.0**places
    return F.floor(_c(x) * scale + 0.5) / scale


def half_life(rho, cap: float = 60.0) -> Column:
    """ln .5 / ln rho in steps: 0 for rho <= 0, the cap for rho >= 1 and beyond it."""
    r = _c(rho)
    return F.when(r <= 0, 0.0).when(r >= 1, cap).otherwise(F.least(F.lit(cap), F.log(F.lit(0.5)) / F.log(r)))


def fisher_interval(r, n, z: float = 1.96) -> Column:
    """95% interval of a correlation as struct(lo, hi); NULL below 10 points or at |r| = 1."""
    rr, nn = _c(r), _c(n)
    centre, half = F.atanh(rr), F.lit(z) / F.sqrt(nn - 3)
    return F.when((nn >= 10) & (F.abs(rr) < 1), F.struct(F.tanh(centre - half).alias("lo"), F.tanh(centre + half).alias("hi")))


def annualised(last, first, months) -> Column:
    """Percent per year between two levels ``months`` apart."""
    return (F.pow(_c(last) / _c(first), F.lit(12.0) / _c(months)) - 1) * 100


def implied_probability(bid, ask, last) -> Column:
    """Mid if quoted (bid > 0 or ask < 1), else a positive last trade, else NULL."""
    b, a, t = _c(bid), _c(ask), _c(last)
    return F.when((b > 0) | (a < 1), (b + a) / 2).when(t > 0, t)


def band(value, cuts: list[float], labels: list[str]) -> Column:
    """Label of the highest cut at or below the value (cuts ascending, one more label than cuts)."""
    v = _c(value)
    out = None
    for cut, label in reversed(list(zip(cuts, labels[1:]))):
        out = F.when(v >= cut, label) if out is None else out.when(v >= cut, label)
    return F.when(v.isNotNull(), out.otherwise(labels[0]))


# Peak-flux classes, W/m^2 at size 1.
FLUX_CLASSES = [("A", 1e-8), ("B", 1e-7), ("C", 1e-6), ("M", 1e-5), ("X", 1e-4)]


def log_class(value) -> Column:
    """Class letter on a log scale and the multiple inside it: M2.5, X12; NULL unless positive."""
    v = _c(value)
    letter, base = F.lit(FLUX_CLASSES[0][0]), F.lit(FLUX_CLASSES[0][1])
    for name, start in FLUX_CLASSES[1:]:
        letter, base = F.when(v >= start, name).otherwise(letter), F.when(v >= start, start).otherwise(base)
    size = v / base
    return F.when(v > 0, F.concat(letter, F.when(size >= 10, F.format_string("%.0f", size)).otherwise(F.format_string("%.1f", size))))


# Earth's gravitational parameter (km^3/s^2), equatorial radius (km), km per AU and per lunar
# distance, diameter (km) at absolute magnitude 0.
EARTH_MU = 398600.4418
EARTH_RADIUS_KM = 6378.137
AU_KM = 149597870.7
LUNAR_DISTANCE_KM = 384400.0
DIAMETER_AT_ZERO_KM = 3550.9


def altitude_km(revs_per_day) -> Column:
    """Mean altitude of an orbit from its mean motion."""
    n = _c(revs_per_day) * (2 * 3.141592653589793) / 86400.0
    return F.cbrt(F.lit(EARTH_MU) / (n * n)) - EARTH_RADIUS_KM


def diameter_m(magnitude) -> Column:
    """Whole metres of diameter from absolute magnitude, at an albedo of 0.14."""
    return F.round(F.pow(F.lit(10.0), -_c(magnitude) / 5) * (DIAMETER_AT_ZERO_KM * 1000))


def lunar_distances(au) -> Column:
    return _c(au) / (LUNAR_DISTANCE_KM / AU_KM)
