"""``%g`` rendering, equal to C's and Python's digit for digit, as built-in expressions.

C rounds the exact binary value, half to even; Java's Formatter rounds the shortest decimal text, half up, which
differs on ties and near them.  Here the value is scaled by a power of ten as an unevaluated sum of two doubles
(Dekker's product and the exact remainder of a division; powers up to 1e22 are exact), so the comparison with the
half is exact wherever a tie is possible.  Exponents beyond 22 go in steps, with some 30 digits, where ties cannot be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 22  # 10 ** 22 is the largest power of ten that a double holds exactly


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _times(a: Column, b: Column) -> Column:
    """a * b as struct<hi, lo> without error (Veltkamp's split, Dekker's product)."""
    def cut(x: Column) -> Column:
        return _let(x * 134217729.0, lambda t: F.struct((t - (t - x)).alias("h")))

    def product(s: Column) -> Column:
        ah, bh = s["ac"]["h"], s["bc"]["h"]
        al, bl, p = s["a"] - ah, s["b"] - bh, s["a"] * s["b"]
        return F.struct(p.alias("hi"), (al * bl - (((p - ah * bh) - al * bh) - ah * bl)).alias("lo"))
    return _let(F.struct(a.alias("a"), b.alias("b"), cut(a).alias("ac"), cut(b).alias("bc")), product)


def _scaled(x: Column, k: Column) -> Column:
    """x * 10 ** k as struct<hi, lo>."""
    exact = F.array(*[F.lit(float(10 ** i)) for i in range(_STEP + 1)])
    size = F.abs(k)
    powers = F.concat(F.array_repeat(F.lit(float(10 ** _STEP)), F.floor(size / _STEP).cast("int")),
                      F.array(F.get(exact, (size % _STEP).cast("int"))))

    def up(v: Column, p: Column) -> Column:
        return _let(_times(v["hi"], p), lambda t: _let(t["lo"] + v["lo"] * p, lambda e: F.struct(
            (t["hi"] + e).alias("hi"), (e - ((t["hi"] + e) - t["hi"])).alias("lo"))))

    def down(v: Column, p: Column) -> Column:
        return _let(v["hi"] / p, lambda q: _let(_times(q, p), lambda t: F.struct(
            q.alias("hi"), ((((v["hi"] - t["hi"]) - t["lo"]) + v["lo"]) / p).alias("lo"))))
    start = F.struct(x.alias("hi"), F.lit(0.0).alias("lo"))
    return F.when(k >= 0, F.aggregate(powers, start, up)).otherwise(F.aggregate(powers, start, down))


def render_number_exact(x: Column, digits: int = 4) -> Column:
    """P10: C's ``%.<digits>g`` of a double; NULL and NaN are NULL.  Digits from 1 to 15."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be 1 to 15")
    x = x.cast("double")
    low, high = float(10 ** (digits - 1)), float(10 ** digits)

    def rounded(v: Column) -> Column:
        """The scaled value as a whole number, half to even."""
        whole = F.floor(v["hi"]).cast("double")
        off = lambda n: ((v["hi"] - n) - 0.5) + v["lo"]
        n = F.when((v["hi"] == whole) & (v["lo"] < 0), whole - 1).otherwise(whole)
        return _let(n, lambda n: n + F.when((off(n) > 0) | ((off(n) == 0) & (n % 2 == 1)), 1.0).otherwise(0.0))

    def text(r: Column) -> Column:
        """From struct<n, e>: the digits and the decimal exponent."""
        carry = r["n"] >= high
        s = F.when(carry, F.lit(str(10 ** (digits - 1)))).otherwise(r["n"].cast("long").cast("string"))
        e = r["e"] + carry.cast("int")
        strip = lambda c: F.regexp_replace(c, "0+$", "")
        dot = lambda c: F.when(c != "", F.concat(F.lit("."), c)).otherwise("")

        def put(t: Column) -> Column:
            s, e = t["s"], t["e"]
            plain = F.when(e >= 0, F.concat(F.substring(s, F.lit(1), e + 1), dot(strip(F.substring(s, e + 2, F.lit(digits)))))) \
                .otherwise(F.concat(F.lit("0"), dot(strip(F.concat(F.repeat(F.lit("0"), -e - 1), s)))))
            power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
            return F.when((e >= -4) & (e < digits), plain).otherwise(
                F.concat(F.substring(s, 1, 1), dot(strip(F.substring(s, 2, digits))), power))
        return _let(F.struct(s.alias("s"), e.alias("e")), put)

    def finite(a: Column) -> Column:
        def settle(t: Column) -> Column:
            """The guess of the exponent may be off by one next to a power of ten."""
            v, e = t["v"], t["e"]
            under = (v["hi"] < low) | ((v["hi"] == low) & (v["lo"] < 0))
            over = (v["hi"] > high) | ((v["hi"] == high) & (v["lo"] >= 0))
            fixed = F.when(under, e - 1).when(over, e + 1).otherwise(e)
            return _let(fixed, lambda e: F.struct(
                _let(F.when(e == t["e"], v).otherwise(_scaled(a, digits - 1 - e)), rounded).alias("n"), e.alias("e")))
        guess = F.floor(F.log10(a)).cast("int")
        return _let(_let(_let(guess, lambda e: F.struct(_scaled(a, digits - 1 - e).alias("v"), e.alias("e"))), settle), text)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    a = F.abs(x)
    return F.when(F.isnan(x), None).when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a == 0, F.concat(sign, F.lit("0"))) \
        .when(x.isNotNull(), F.concat(sign, _let(a, finite)))


def render_numbers_exact(cells: list[Column], digits: int = 4) -> Column:
    """The texts of several cells as one array: one expression for all of them, planned once."""
    return F.transform(F.array(*[c.cast("double") for c in cells]), lambda x: render_number_exact(x, digits))
