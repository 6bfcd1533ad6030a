"""Statistical column expressions: Student-t p-value, adjusted skewness,
hexagonal grid cells. All JVM-side (higher-order SQL functions, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def t_two_sided_p(t, dof) -> Column:
    """Exact two-sided p-value of Student's t with integer ``dof``.

    Finite series for the t distribution function (Abramowitz & Stegun
    26.7.3 / 26.7.4), with theta = atan(|t| / sqrt(nu)):
      nu = 1:     A = 2 theta / pi
      nu odd:     A = 2/pi (theta + sin(theta) * sum_{j=0}^{(nu-3)/2} d_j cos^{2j+1} theta),
                  d_0 = 1, d_j = d_{j-1} 2j / (2j+1)
      nu even:    A = sin(theta) * sum_{j=0}^{(nu-2)/2} c_j cos^{2j} theta,
                  c_0 = 1, c_j = c_{j-1} (2j-1) / (2j)
    and p = 1 - A. The sums run as ``aggregate`` over ``sequence``, carrying
    (sum, coefficient, power of cos). Null t (zero pooled variance) gives
    null p.
    """
    t = _col(t).cast("double")
    nu = _col(dof).cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    c = F.cos(theta)
    s = F.sin(theta)

    init = F.struct(F.lit(0.0).alias("acc"), F.lit(1.0).alias("coef"), F.lit(1.0).alias("pw"))

    # even: terms j = 0..(nu-2)/2 of c_j cos^{2j}
    even_sum = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.floor((nu - 2) / 2).cast("int"), F.lit(0))),
        init,
        lambda st, j: F.struct(
            (st["acc"] + st["coef"] * st["pw"]).alias("acc"),
            (st["coef"] * (F.lit(2.0) * (j + 1) - 1) / (F.lit(2.0) * (j + 1))).alias("coef"),
            (st["pw"] * c * c).alias("pw")),
        lambda st: st["acc"])
    a_even = s * even_sum

    # odd (> 1): terms j = 0..(nu-3)/2 of d_j cos^{2j+1}
    init_odd = F.struct(F.lit(0.0).alias("acc"), F.lit(1.0).alias("coef"), c.alias("pw"))
    odd_sum = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.floor((nu - 3) / 2).cast("int"), F.lit(0))),
        init_odd,
        lambda st, j: F.struct(
            (st["acc"] + st["coef"] * st["pw"]).alias("acc"),
            (st["coef"] * (F.lit(2.0) * (j + 1)) / (F.lit(2.0) * (j + 1) + 1)).alias("coef"),
            (st["pw"] * c * c).alias("pw")),
        lambda st: st["acc"])
    a_odd = F.lit(2.0 / math.pi) * (theta + s * odd_sum)
    a_one = F.lit(2.0 / math.pi) * theta

    a = (F.when(nu == 1, a_one)
          .when(nu % 2 == 0, a_even)
          .otherwise(a_odd))
    return F.when(t.isNull() | (nu < 1), F.lit(None).cast("double")).otherwise(F.lit(1.0) - a)


def exact_avg(c) -> Column:
    """Mean whose value does not depend on the partitioning: the sum runs in
    ``decimal(38,18)`` (exact, so any merge order gives the same total) and
    is rounded back to double once. A double sum can land a hair either side
    of a value such as 538.3046875, which then rounds differently."""
    return F.avg(_col(c).cast("decimal(38,18)")).cast("double")


def adjusted_skewness(c) -> Column:
    """Sample skewness with the bias correction pandas / SQL engines use:
    g1 * sqrt(n (n-1)) / (n-2), where Spark's ``skewness`` is g1."""
    x = _col(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def hex_cell(x: Column, y: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column,
             gridsize: int = 30) -> Column:
    """Cell of the two-lattice hexagonal grid for point (x, y).

    Public hexbin rule: nx = gridsize, ny = int(nx / sqrt 3); x range padded
    by 1e-9 of its width; scaled coordinates (ix, iy); candidate 1 is the
    rounded point (half to even), candidate 2 is the floored point + 1/2;
    the point goes to candidate 1 when (dx^2 + 3 dy^2) is strictly smaller.
    Returns struct(lattice, i, j, cx, cy)."""
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    pad = (xmax - xmin) * F.lit(1e-9)
    x0 = xmin - pad
    x1 = xmax + pad
    sx = (x1 - x0) / F.lit(float(nx))
    sy = (ymax - ymin) / F.lit(float(ny))
    ix = (x - x0) / sx
    iy = (y - ymin) / sy
    ix1 = F.rint(ix)
    iy1 = F.rint(iy)
    ix2 = F.floor(ix).cast("double")
    iy2 = F.floor(iy).cast("double")
    d1 = (ix - ix1) * (ix - ix1) + F.lit(3.0) * (iy - iy1) * (iy - iy1)
    d2 = (ix - ix2 - 0.5) * (ix - ix2 - 0.5) + F.lit(3.0) * (iy - iy2 - 0.5) * (iy - iy2 - 0.5)
    first = d1 < d2
    return F.when(first, F.struct(
        F.lit(1).alias("lattice"), ix1.cast("long").alias("i"), iy1.cast("long").alias("j"),
        (x0 + ix1 * sx).alias("cx"), (ymin + iy1 * sy).alias("cy"))
    ).otherwise(F.struct(
        F.lit(2).alias("lattice"), ix2.cast("long").alias("i"), iy2.cast("long").alias("j"),
        (x0 + (ix2 + 0.5) * sx).alias("cx"), (ymin + (iy2 + 0.5) * sy).alias("cy")))
