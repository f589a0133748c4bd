"""The material law as column algebra on the four entries of a 2x2 matrix."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SimParams
from ..plans.lineage import apart


class Matrix(NamedTuple):
    a: Column  # row 0, column 0
    b: Column  # row 0, column 1
    c: Column  # row 1, column 0
    d: Column  # row 1, column 1

    @property
    def det(self) -> Column:
        return self.a * self.d - self.b * self.c

    @property
    def norm(self) -> Column:
        return F.sqrt(self.a * self.a + self.b * self.b + self.c * self.c + self.d * self.d)

    def times(self, o: Matrix) -> Matrix:
        return Matrix(
            self.a * o.a + self.b * o.c,
            self.a * o.b + self.b * o.d,
            self.c * o.a + self.d * o.c,
            self.c * o.b + self.d * o.d,
        )

    @property
    def t(self) -> Matrix:
        return Matrix(self.a, self.c, self.b, self.d)

    @property
    def dev(self) -> Matrix:
        half = (self.a + self.d) * 0.5
        return Matrix(self.a - half, self.b, self.c, self.d - half)


#: Suffixes of a matrix's columns, row by row.
ENTRIES = ("00", "01", "10", "11")


def matrix(prefix: str) -> Matrix:
    return Matrix(*[F.col(prefix + k) for k in ENTRIES])


def kirchhoff(f: Matrix, prm: SimParams) -> Matrix:
    """Kirchhoff stress of deformation gradient f."""
    j, dev = f.det, f.times(f.t).dev
    shear, bulk = F.try_divide(F.lit(prm.lame_mu), j), 0.5 * prm.kappa * (j * j - 1)
    return Matrix(shear * dev.a + bulk, shear * dev.b, shear * dev.c, shear * dev.d + bulk)


def trial(f: Matrix, prm: SimParams) -> tuple[Column, Column]:
    """Pressure and deviator."""
    j = f.det
    p = -0.5 * prm.kappa * (j * j - 1)
    q = math.sqrt(2) * F.try_divide(F.lit(prm.lame_mu), j) * f.times(f.t).dev.norm
    return p, q


def crushed(p: Column, q: Column, prm: SimParams) -> Column:
    """Whether (p, q) lies outside the failure surface."""
    p_max, p_min, p_min2, q_max = (
        prm.compressive_strength,
        -prm.tensile_strength,
        -prm.tensile_strength2,
        prm.shear_strength,
    )
    q0 = 2 * math.sqrt(-p_max * p_min) * q_max / (p_max - p_min)
    pulled = (p < p_min2) | (q > -(q0 / p_min2) * (p - p_min2))
    pressed = (1 + 2 * prm.beta) * q * q + prm.m_squared * (p + prm.beta * p_max) * (p - p_max) > 0
    return F.when(p < 0, pulled).otherwise(pressed)


class Svd(NamedTuple):
    """f = U diag(s0, s1) V^T with U = [[uc, us], [-us, uc]], V likewise; s0 >= s1, s1 may be negative."""

    s0: Column
    s1: Column
    uc: Column
    us: Column
    vc: Column
    vs: Column

    def rebuilt(self, x: Column, y: Column) -> Matrix:
        """U diag(x, y) V^T."""
        uc, us, vc, vs = self.uc, self.us, self.vc, self.vs
        return Matrix(
            uc * x * vc + us * y * vs,
            -uc * x * vs + us * y * vc,
            -us * x * vc + uc * y * vs,
            us * x * vs + uc * y * vc,
        )


def svd(f: Matrix) -> Svd:
    """Singular values through the sum and difference of the rotations of U and V.

    A 2x2 matrix is a scaled rotation plus a scaled reflection. With their radii
    r and m the singular values are r + m and r - m (negative if the matrix
    reverses orientation), and the angles of U and V are half the sum and
    difference of their directions.
    """
    e, g = (f.a + f.d) * 0.5, (f.c - f.b) * 0.5
    k, l = (f.a - f.d) * 0.5, (f.c + f.b) * 0.5
    r, m = F.sqrt(e * e + g * g), F.sqrt(k * k + l * l)
    turn, skew = F.atan2(g, e), F.atan2(l, k)
    u, v = (skew + turn) * 0.5, (skew - turn) * 0.5
    return Svd(r + m, r - m, F.cos(u), -F.sin(u), F.cos(v), -F.sin(v))


def yield_q(x: Column, prm: SimParams) -> Column:
    """Largest deviator that crushed material bears at pressure x."""
    p_max, p_min = prm.compressive_strength, -prm.tensile_strength
    cap = 2 * F.sqrt(F.greatest((p_max - x) * (x - p_min), F.lit(0.0))) * prm.shear_strength / (p_max - p_min)
    friction = F.greatest(F.lit(0.0), (x - prm.dp_threshold) * prm.tan_phi)
    return F.when(x < p_max, F.least(cap, friction)).otherwise(0.0)


def return_map(df: DataFrame, prm: SimParams) -> DataFrame:
    """Plastic return of crushed material onto its yield surface.

    Adds r_case, r_fe00 … r_fe11 and r_jp_inv to rows with fe00 … fe11, jp_inv
    and thickness. Parts that are used often become columns of their own, so
    that no expression is written out many times in the generated code.
    """
    f, kept = matrix("fe"), df.columns
    p, q = trial(f, prm)
    s = svd(f)
    one = df.withColumns({"r_p": p, "r_q": q, "r_j": f.det, "r_s0": s.s0, "r_s1": s.s1})
    one = apart(one.withColumns({"r_uc": s.uc, "r_us": s.us, "r_vc": s.vc, "r_vs": s.vs}))
    ridge = prm.ridge_coeff * 9.8 * prm.ice_density * F.col("thickness") * F.col("jp_inv")
    open_ = F.col("r_p") < prm.dp_threshold
    case = (
        F.when(open_ & (F.col("jp_inv") < 0.1), 0)
        .when(open_, 1)
        .when(F.col("r_q") <= yield_q(F.col("r_p"), prm), 2)
        .otherwise(3)
    )
    two = one.withColumns({"r_case": case, "r_pn": F.least("r_p", ridge)})
    three = two.withColumns(
        {"r_qn": yield_q(F.col("r_pn"), prm), "r_jn": F.sqrt(F.greatest(1 - 2 * F.col("r_pn") / prm.kappa, F.lit(0.0)))}
    )
    # Of the deviator of diag(s0^2, s1^2) only the direction is kept: its entries are opposite.
    half = F.col("r_s0") * F.col("r_s0") - F.col("r_s1") * F.col("r_s1")
    stretch = F.col("r_qn") * 0.5 * F.abs("r_j") / prm.lame_mu * F.signum(half)
    even = F.sqrt(F.greatest("r_j", F.lit(0.0)))

    def value(kept_one: str, pushed: Column) -> Column:
        pressed = F.sqrt(F.greatest(pushed, F.lit(0.0)))
        return F.when(F.col("r_case") == 0, even).when(F.col("r_case") == 1, 1.0).when(F.col("r_case") == 2, F.col(kept_one)).otherwise(pressed)

    four = apart(three).withColumns({"r_x": value("r_s0", F.col("r_jn") + stretch), "r_y": value("r_s1", F.col("r_jn") - stretch)})
    turned = Svd(*[F.col(f"r_{n}") for n in Svd._fields]).rebuilt(F.col("r_x"), F.col("r_y"))
    new = {f"r_fe{k}": F.when(F.col("r_case") == 2, old).otherwise(n) for k, old, n in zip(ENTRIES, f, turned, strict=True)}
    jp_inv = F.col("jp_inv")
    ratio = (
        F.when(F.col("r_case") == 1, F.try_divide(jp_inv, F.col("r_j")))
        .when(F.col("r_case") == 3, F.try_divide(jp_inv * F.col("r_jn"), F.col("r_j")))
        .otherwise(jp_inv)
    )
    out = four.withColumns({**new, "r_jp_inv": ratio})
    return out.select(*kept, "r_case", *[f"r_fe{k}" for k in ENTRIES], "r_jp_inv")
