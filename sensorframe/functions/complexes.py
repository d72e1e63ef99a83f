"""Complex arithmetic on pairs of columns, and the impedance of circuit elements."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Z:
    re: Column
    im: Column

    def __add__(self, o: Z) -> Z:
        return Z(self.re + o.re, self.im + o.im)

    def __mul__(self, o: Z) -> Z:
        return Z(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def inverse(self) -> Z:
        n = self.re * self.re + self.im * self.im
        return Z(self.re / n, -self.im / n)

    def parallel(self, o: Z) -> Z:
        return (self.inverse() + o.inverse()).inverse()

    def sqrt(self) -> Z:
        m = F.sqrt(F.hypot(self.re, self.im))
        a = F.atan2(self.im, self.re) / 2
        return Z(m * F.cos(a), m * F.sin(a))

    def tanh(self) -> Z:
        d = F.cosh(2 * self.re) + F.cos(2 * self.im)
        return Z(F.sinh(2 * self.re) / d, F.sin(2 * self.im) / d)


def real(x: Column) -> Z:
    return Z(x, F.lit(0.0))


def resistor(r: Column, w: Column) -> Z:
    return real(r)


def capacitor(c: Column, w: Column) -> Z:
    return Z(F.lit(0.0), -1 / (w * c))


def inductor(value: Column, w: Column) -> Z:
    return Z(F.lit(0.0), w * value)


def i_omega_power(w: Column, alpha: Column) -> Z:
    """(i w)^alpha."""
    m = F.pow(w, alpha)
    return Z(m * F.cos(math.pi / 2 * alpha), m * F.sin(math.pi / 2 * alpha))


def cpe(q: Column, alpha: Column, w: Column) -> Z:
    z = i_omega_power(w, alpha)
    return Z(q * z.re, q * z.im).inverse()


def warburg(sigma: Column, w: Column) -> Z:
    return Z(sigma / F.sqrt(w), -sigma / F.sqrt(w))


def finite_warburg(r: Column, tau: Column, w: Column, blocked: bool = False) -> Z:
    """R tanh(sqrt(i w tau)) / sqrt(i w tau), or with coth for a blocking end."""
    root = Z(F.lit(0.0), w * tau).sqrt()
    t = root.tanh()
    return real(r) * (t.inverse() if blocked else t) * root.inverse()


def gerischer(r: Column, tau: Column, w: Column) -> Z:
    return real(r) * Z(F.lit(1.0), w * tau).sqrt().inverse()


def zarc(r: Column, tau: Column, alpha: Column, w: Column) -> Z:
    z = i_omega_power(w * tau, alpha)
    return real(r) * Z(1 + z.re, z.im).inverse()


#: Elements by kind: the impedance from up to three parameters p1, p2, p3 and the angular frequency.
ELEMENTS = {
    "R": lambda p, w: resistor(p[0], w), "C": lambda p, w: capacitor(p[0], w), "L": lambda p, w: inductor(p[0], w), "W": lambda p, w: warburg(p[0], w),
    "CPE": lambda p, w: cpe(p[0], p[1], w), "Wo": lambda p, w: finite_warburg(p[0], p[1], w, True), "Ws": lambda p, w: finite_warburg(p[0], p[1], w),
    "G": lambda p, w: gerischer(p[0], p[1], w), "Zarc": lambda p, w: zarc(p[0], p[1], p[2], w),
}


def circuit(tree, params: dict[str, list[Column]], w: Column) -> Z:
    """Impedance of a tree of ("series" | "parallel", [children]) and element names like "R1", whose letters name the kind."""
    if isinstance(tree, str):
        return ELEMENTS[tree.rstrip("0123456789")](params[tree], w)
    kind, children = tree
    out = circuit(children[0], params, w)
    for child in children[1:]:
        z = circuit(child, params, w)
        out = out + z if kind == "series" else out.parallel(z)
    return out
