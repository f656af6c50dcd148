"""Digests, base-N texts, check digits, identifiers and URLs as columns."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def digest(x: Column, algorithm: str = "sha256") -> Column:
    """The hexadecimal digest of text or bytes: md5, sha1, sha224 .. sha512, crc32 or xxhash64."""
    b = x.cast("binary")
    if algorithm.startswith("sha") and algorithm != "sha1":
        return F.sha2(b, int(algorithm[3:]))
    plain = {"md5": F.md5, "sha1": F.sha1, "crc32": lambda v: F.lower(F.hex(F.crc32(v))), "xxhash64": lambda v: F.lower(F.hex(F.xxhash64(v)))}
    return plain[algorithm](b)


def digest_row(*columns: Column) -> Column:
    """One digest of several values; nulls and boundaries between values count."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    """Bytes, or null where the text is not hexadecimal."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def to_base64(b: Column, url_safe: bool = False) -> Column:
    # Spark may break long texts into lines.
    plain = F.translate(F.base64(b), "\r\n", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("=")) if url_safe else plain


def from_base64(s: Column) -> Column:
    """Bytes of either alphabet, padded or not, in one line or several."""
    plain = F.translate(F.rtrim(F.translate(s, "\r\n", ""), F.lit("=")), "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def to_base2(b: Column) -> Column:
    """Bits of every byte, eight each."""
    digits = F.hex(b)
    places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    eight = lambda i: F.lpad(F.conv(F.substring(digits, i, F.lit(2)), 16, 2), 8, "0")
    return F.when(F.length(digits) == 0, F.lit("")).otherwise(F.array_join(F.transform(places, eight), ""))


@pandas_udf(T.StringType())
def to_base32(b: pd.Series) -> pd.Series:
    return b.map(lambda x: base64.b32encode(x).decode(), na_action="ignore")


@pandas_udf(T.BinaryType())
def from_base32(s: pd.Series) -> pd.Series:
    def one(t: str) -> bytes | None:
        try:
            return base64.b32decode(t + "=" * (-len(t) % 8))
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


# Check digits


def luhn_valid(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def luhn_digit(s: Column) -> Column:
    """The digit that completes a number, 0 to 9."""
    digits = F.transform(F.split(F.reverse(s), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def isin_digits(s: Column) -> Column:
    """The letters of an ISIN as numbers from 10."""
    letter = lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)
    return F.array_join(F.transform(F.split(s, ""), letter), "")


def isin_valid(s: Column) -> Column:
    return s.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", isin_digits(s))


def isin_country(s: Column) -> Column:
    return F.when(isin_valid(s), F.left(s, F.lit(2)))


def isin_nsin(s: Column) -> Column:
    return F.when(isin_valid(s), F.substring(s, 3, 9))


# Identifiers


def uuid(s: Column) -> Column:
    """The canonical form of a UUID, or null."""
    bare = F.lower(F.regexp_replace(s, "[{}-]", ""))
    parts = [F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


_SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def semver(s: Column) -> Column:
    """struct(major, minor, patch, prerelease, build) of a semantic version, or null."""
    get = lambda i: F.nullif(F.regexp_extract(s, _SEMVER, i), F.lit(""))
    numbers = [get(i).cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(s.rlike(_SEMVER), F.struct(*numbers, get(4).alias("prerelease"), get(5).alias("build")))


def semver_key(s: Column) -> Column:
    """A column by which versions sort by precedence: numbers before words, a release after its prereleases."""
    v = semver(s)
    part = lambda p: F.when(
        p.rlike(r"^\d+$"), F.struct(F.lit(0).alias("word"), F.lpad(p, 20, "0").alias("value"))
    ).otherwise(F.struct(F.lit(1).alias("word"), p.alias("value")))
    tail = F.transform(F.split(v["prerelease"], "\\."), part)
    return F.struct(
        v["major"].alias("major"),
        v["minor"].alias("minor"),
        v["patch"].alias("patch"),
        v["prerelease"].isNull().alias("released"),
        F.coalesce(tail, F.array().cast("array<struct<word:int,value:string>>")).alias("tail"),
    )


def url(s: Column) -> Column:
    """struct of a URL's parts, null where it is none."""
    parts = ("PROTOCOL", "HOST", "PATH", "QUERY", "REF", "AUTHORITY", "USERINFO")
    return F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.struct(*[F.try_parse_url(s, F.lit(p)).alias(p.lower()) for p in parts]))


def geo_uri(s: Column) -> Column:
    """struct(latitude, longitude) of a ``geo:`` URI, or null."""
    pattern = r"^geo:(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
    get = lambda i: F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).cast("double")
    return F.when(s.rlike(pattern), F.struct(get(1).alias("latitude"), get(2).alias("longitude")))


# Texts and bytes


def decoded(b: Column, charset: str = "UTF-8", malformed: str = "substitute") -> Column:
    """Text of bytes; malformed input is substituted, gives null (``skip``), or raises (``strict``)."""
    if charset.upper() != "UTF-8":
        return F.decode(b, charset)
    text = b.cast("string")
    return {"substitute": F.make_valid_utf8, "skip": F.try_validate_utf8, "strict": F.validate_utf8}[malformed](text)


# Compression


def _packer(algorithm: str):
    import bz2
    import gzip
    import lzma
    import zlib

    known = {
        "gzip": (lambda x: gzip.compress(x, mtime=0), gzip.decompress),
        "zlib": (zlib.compress, zlib.decompress),
        "deflate": (lambda x: zlib.compress(x, wbits=-15), lambda x: zlib.decompress(x, wbits=-15)),
        "bzip2": (bz2.compress, bz2.decompress),
        "xz": (_xz, lzma.decompress),
    }
    return known[algorithm]


def _xz(x: bytes) -> bytes:
    """A dictionary larger than the value finds nothing more, but clearing the usual one of 8 MB takes most of the time."""
    import lzma

    size = min(max(len(x), 1 << 12), 1 << 23)
    return lzma.compress(x, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])


def compress(b: Column, algorithm: str = "gzip") -> Column:
    """Each value's bytes compressed by gzip, zlib, deflate, bzip2 or xz; files take Spark's own codecs instead."""
    _packer(algorithm)

    @pandas_udf(T.BinaryType())
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: _packer(algorithm)[0](bytes(v)), na_action="ignore")

    return pack(b)


def decompress(b: Column, algorithm: str = "gzip") -> Column:
    """The bytes again; null where they are no such stream."""
    _packer(algorithm)

    def one(v: bytes) -> bytes | None:
        try:
            return _packer(algorithm)[1](bytes(v))
        except (OSError, EOFError, ValueError, *_errors()):
            return None

    @pandas_udf(T.BinaryType())
    def unpack(x: pd.Series) -> pd.Series:
        return x.map(one, na_action="ignore")

    return unpack(b)


def _errors() -> tuple:
    import lzma
    import zlib

    return zlib.error, lzma.LZMAError
