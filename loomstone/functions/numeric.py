"""Numbers, vectors, matrices, money, angles and places as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Scalars


def floor_mod(a: Column, n: Column) -> Column:
    """The remainder with the sign of the divisor."""
    return a - n * F.floor(a / n)


def floor_div(a: Column, n: Column) -> Column:
    return F.floor(a / n)


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def round_to(x: Column, scale: int, mode: str = "half_up") -> Column:
    """A decimal rounded by one of seven modes: up, down, ceiling, floor, half_up, half_down, half_even."""
    unit = 10**scale
    scaled, sign = x * unit, F.signum(x)
    size = F.abs(scaled)
    whole = {
        "up": lambda: sign * F.ceil(size),
        "down": lambda: sign * F.floor(size),
        "ceiling": lambda: F.ceil(scaled),
        "floor": lambda: F.floor(scaled),
        "half_up": lambda: sign * F.floor(size + 0.5),
        "half_down": lambda: sign * F.ceil(size - 0.5),
        "half_even": lambda: F.bround(scaled, 0),
    }[mode]()
    return whole / unit


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor by Euclid's steps: as many as the lesser number's bits can ask for, 93 for any two longs."""
    bits = F.length(F.bin(F.least(F.abs(a), F.abs(b)).cast("long")))
    most = F.least(F.ceil(bits * 1.45).cast("int") + 3, F.lit(93))
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs((a / gcd(a, b)).cast("long") * b))


def erf(x: Column) -> Column:
    """The error function by a rational approximation of five terms, right to about 1.5e-7."""
    # The coefficients of the approximation.
    p, terms = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(terms):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def radix(n: Column, base: int) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, base))


def scalb(x: Column, n: Column | int) -> Column:
    return x * F.pow(F.lit(2.0), n if isinstance(n, Column) else F.lit(n))


@pandas_udf(T.DoubleType())
def ulp(x: pd.Series) -> pd.Series:
    """The distance to the next double of greater magnitude."""
    return pd.Series(np.spacing(np.abs(x.to_numpy())))


@pandas_udf(T.DoubleType())
def next_up(x: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(), np.inf))


@pandas_udf(T.DoubleType())
def next_down(x: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(), -np.inf))


@pandas_udf(T.IntegerType())
def exponent(x: pd.Series) -> pd.Series:
    """The unbiased binary exponent."""
    return pd.Series(np.frexp(x.to_numpy())[1] - 1)


@pandas_udf(T.LongType())
def bits(x: pd.Series) -> pd.Series:
    """The bits of a double as a long."""
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


# Rationals: struct(num, den) with a positive denominator in lowest terms


def _once(f, **parts: Column) -> Column:
    """``f`` of a struct of the parts, each of which is reckoned once however often ``f`` names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), f), F.lit(0))


def rational(num: Column, den: Column) -> Column:
    divisor = lambda s: gcd(s["num"], s["den"]) * F.when(s["den"] < 0, F.lit(-1)).otherwise(F.lit(1))
    lowest = lambda n, d, g: F.when(d != 0, F.struct((n / g).cast("long").alias("num"), (d / g).cast("long").alias("den")))
    return _once(lambda s: _once(lambda t: lowest(s["num"], s["den"], t["g"]), g=divisor(s)), num=num, den=den)


def add_rationals(a: Column, b: Column) -> Column:
    total = lambda a, b: rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])
    return _once(lambda s: total(s["a"], s["b"]), a=a, b=b)


def multiply_rationals(a: Column, b: Column) -> Column:
    return _once(lambda s: rational(s["a"]["num"] * s["b"]["num"], s["a"]["den"] * s["b"]["den"]), a=a, b=b)


# Vectors: arrays of doubles


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unitary(a: Column) -> Column:
    """The vector of length one; null for one of length nought. The length is reckoned once."""
    held = F.array(F.struct(a.alias("a"), norm(a).alias("n")))
    return F.get(F.transform(held, lambda s: F.when(s["n"] != 0, F.transform(s["a"], lambda x: x.cast("double") / s["n"]))), F.lit(0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def cross(a: Column, b: Column) -> Column:
    """The cross product in three dimensions."""
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


# Matrices: arrays of rows


def transpose(m: Column) -> Column:
    columns = F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1)
    return F.transform(columns, lambda j: F.transform(m, lambda r: F.get(r, j)))


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(n)]) for i in range(n)])


def matrix_multiply(a: Column, b: Column) -> Column:
    columns = transpose(b)
    return F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))


def matrix_apply(m: Column, v: Column) -> Column:
    return F.transform(m, lambda r: dot(r, v))


def matrix_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, add)


def matrix_trace(m: Column) -> Column:
    return _sum(F.transform(m, lambda r, i: F.get(r, i)))


def frobenius(m: Column) -> Column:
    return norm(F.flatten(m))


def submatrix(m: Column, row: int, column: int) -> Column:
    """The matrix without a row and a column."""
    return F.transform(F.filter(m, lambda r, i: i != row), lambda r: F.filter(r, lambda x, j: j != column))


def _linear(kind: T.DataType, f):
    @pandas_udf(kind)
    def call(m: pd.Series) -> pd.Series:
        def one(rows):
            try:
                return f(np.array([np.asarray(r, float) for r in rows]))
            except np.linalg.LinAlgError:
                return None

        return m.map(one, na_action="ignore")

    return call


determinant = _linear(T.DoubleType(), lambda a: float(np.linalg.det(a)))
inverse = _linear(T.ArrayType(T.ArrayType(T.DoubleType())), lambda a: np.linalg.inv(a).tolist())
rank = _linear(T.IntegerType(), lambda a: int(np.linalg.matrix_rank(a)))
#: Real eigenvalues, ascending; null where some are not real.
eigenvalues = _linear(T.ArrayType(T.DoubleType()), lambda a: None if np.iscomplex(e := np.linalg.eigvals(a)).any() else sorted(e.real.tolist()))


def cofactor(m: Column, row: int, column: int) -> Column:
    return determinant(submatrix(m, row, column)) * (-1) ** (row + column)


def solve(inverted: Column, v: Column) -> Column:
    """The solution for ``v``, from a column that holds the matrix's inverse."""
    return matrix_apply(inverted, v)


def matrix_product_rows(a, b):
    """The product of matrices given as rows (i, j, v): a join on the inner index and a sum, of any size."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


# Complex numbers: struct(re, im)


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def argument(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def complex_sqrt(z: Column) -> Column:
    m = modulus(z)
    im = F.sqrt(F.greatest((m - z["re"]) / 2, F.lit(0.0)))
    return F.struct(F.sqrt(F.greatest((m + z["re"]) / 2, F.lit(0.0))).alias("re"), F.when(z["im"] < 0, -im).otherwise(im).alias("im"))


# Money: whole minor units


def share(minor: Column, n: int) -> Column:
    """An amount shared ``n`` ways without loss: the remainder goes to the first shares, a unit each."""
    size, sign = F.abs(minor), F.signum(minor).cast("long")
    rest = size % n
    return F.array(*[sign * ((size - rest) / n).cast("long") + sign * F.when(rest > k, 1).otherwise(0) for k in range(n)])


def with_tax(principal: Column, rate: Column | float) -> Column:
    """struct(principal, tax, inclusive) in minor units, the tax rounded half up."""
    tax = round_half_up(principal * rate).cast("long")
    return F.struct(principal.alias("principal"), tax.alias("tax"), (principal + tax).alias("inclusive"))


# Angles and places: degrees for latitude and longitude, radians for angles


def principal(a: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return F.pmod(a, 2 * F.pi())


def canonical(a: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def surface_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The central angle between two places by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The initial bearing in degrees from north, clockwise."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.pmod(F.degrees(angle), F.lit(360.0))


# The sixteen points of the compass from north, clockwise.
_COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def compass(degrees: Column, n: int = 16) -> Column:
    """The name of a bearing among 4, 8 or 16 points."""
    names = F.array(*[F.lit(c) for c in _COMPASS[:: 16 // n]])
    return F.get(names, F.pmod(F.floor(degrees / (360 / n) + 0.5), F.lit(n)).cast("int"))


# The letters of geohashes in their order.
_GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, n: int = 8) -> Column:
    """The geohash of ``n`` letters: bits of longitude and latitude in turn, five to a letter."""
    total = 5 * n
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    cell = lambda x, low, width, k: F.least(F.floor((x - low) / width * 2**k), F.lit(2**k - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    letters = []
    for letter in range(n):
        value = F.lit(0)
        for b in range(5 * letter, 5 * letter + 5):
            source, place = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1)).cast("int")
        letters.append(F.substring(F.lit(_GEOHASH), value + 1, F.lit(1)))
    return F.concat(*letters)


# Units: a factor to the base unit of each


# What one of each is in its SI base unit.
UNITS = {
    "metre": 1.0,
    "kilometre": 1000.0,
    "inch": 0.0254,
    "foot": 0.3048,
    "yard": 0.9144,
    "mile": 1609.344,
    "kilogram": 1.0,
    "gram": 0.001,
    "pound": 0.45359237,
    "ounce": 0.028349523125,
    "second": 1.0,
    "minute": 60.0,
    "hour": 3600.0,
    "day": 86400.0,
}


def convert(x: Column, source: str, target: str) -> Column:
    return x * (UNITS[source] / UNITS[target])


def celsius_to_kelvin(x: Column) -> Column:
    return x + 273.15


def fahrenheit_to_kelvin(x: Column) -> Column:
    return (x + 459.67) * 5 / 9


def metric_prefix(x: Column) -> Column:
    """The prefix that leaves a magnitude from 1 up to 1000."""
    steps = [(1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ")]
    out = F.when(F.abs(x) >= steps[0][0], F.lit(steps[0][1]))
    for least, name in steps[1:]:
        out = out.when(F.abs(x) >= least, F.lit(name))
    return out.otherwise(F.lit("n"))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(hue in degrees, saturation, value) of red, green and blue from 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, F.lit(0.0)).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct((60 * h).alias("hue"), F.when(high == 0, F.lit(0.0)).otherwise(d / high).alias("saturation"), high.alias("value"))


def mixed_radix(x: Column, sizes: list[int]) -> Column:
    """A whole number in mixed units, largest first; ``sizes`` says how many of each make one of the unit before."""
    parts, rest = [], x.cast("long")
    for size in reversed(sizes):
        parts.append(F.pmod(rest, F.lit(size).cast("long")))
        rest = F.floor(rest / size).cast("long")
    return F.array(rest, *reversed(parts))


def decimalize(x: Column, digits: int) -> Column:
    """A number rounded to so many significant figures."""
    power = F.floor(F.log10(F.abs(x))) + 1 - digits
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / F.pow(F.lit(10.0), power)) * F.pow(F.lit(10.0), power))


def multiply_complex(a: Column, b: Column) -> Column:
    re = a["re"] * b["re"] - a["im"] * b["im"]
    return F.struct(re.alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def _adjugate(a: np.ndarray) -> list:
    """From minors, so that singular matrices have one, too."""
    n = len(a)
    minor = lambda i, j: np.linalg.det(np.delete(np.delete(a, i, 0), j, 1)) if n > 1 else 1.0
    return [[float((-1) ** (i + j) * minor(j, i)) for j in range(n)] for i in range(n)]


def _eigenvectors(a: np.ndarray) -> list | None:
    values, vectors = np.linalg.eig(a)
    if np.iscomplex(values).any():
        return None
    vectors = vectors.real[:, np.argsort(values.real, kind="stable")]
    lead = vectors[np.argmax(np.abs(vectors) > 1e-12, axis=0), np.arange(len(a))]
    return (vectors * np.where(lead < 0, -1, 1)).T.tolist()


#: The transposed matrix of cofactors.
adjugate = _linear(T.ArrayType(T.ArrayType(T.DoubleType())), _adjugate)
#: Unit eigenvectors as rows, by ascending eigenvalue, their first part that is not nought positive; null where some are not real.
eigenvectors = _linear(T.ArrayType(T.ArrayType(T.DoubleType())), _eigenvectors)
