"""Version strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, let, strip

#: Fixed value: the version grammar of PEP 440, as a pattern over lower-case text; group 2 is the release.
PEP440 = (
    r"^v?(?:(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(?:alpha|a|beta|b|preview|pre|c|rc)[-_.]?(?:[0-9]+)?)?"
    r"(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?(?:[0-9]+)?)?"
    r"(?:[-_.]?dev[-_.]?(?:[0-9]+)?)?)"
    r"(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?$"
)
#: What most versions look like; saves them the long pattern.
PLAIN = r"^[0-9]+(?:\.[0-9]+)*$"
#: The shapes that settle a tier before numbers are compared.
SHA = r"(?i)^[0-9a-f]{40}$"
CALVER = r"^[0-9]{4}\.[0-9]{1,2}(?:\.[0-9]{1,2})?$"
PRERELEASE = r"-[0-9A-Za-z]"


def _quotes(c: Column) -> Column:
    return F.btrim(c, F.lit("\"'"))


def normalise_version(c: Column | str) -> Column:
    """Blanks, quotes and leading range operators taken off."""
    bare = F.regexp_replace(_quotes(strip(c)), r"^((>=|<=|==|!=|~=|[\^~><=])\s*)+", "")
    return _quotes(strip(bare))


def release(c: Column | str) -> Column:
    """The first three release numbers as text without leading zeros, padded with '0'; null without any digit.

    Numbers stay text, so that none is too long to compare.
    """
    found = lambda v: F.when(v.rlike(PLAIN), v).otherwise(F.regexp_extract(v, PEP440, 2))
    digits = lambda v: let(found(v), lambda r: F.when(r != "", F.split(r, r"\.")).otherwise(F.regexp_extract_all(v, F.lit(r"(\d+)"), 1)))
    bare = lambda parts: F.transform(parts, lambda x: F.when(x.startswith("0"), F.regexp_replace(x, r"^0+(?=\d)", "")).otherwise(x))
    padded = lambda parts: F.when(F.size(parts) > 0, F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), 1, 3))
    return let(let(F.lower(strip(c)), lambda v: bare(digits(v))), padded)


def semver_tier(old: Column | str, new: Column | str) -> Column:
    """sha-pin, calver, prerelease, major, minor, patch or unknown; the first that holds for either side."""

    def tier(v: Column) -> Column:
        a, b, p, q = v["a"], v["b"], v["p"], v["q"]
        shape = lambda pattern: a.rlike(pattern) | b.rlike(pattern)
        differ = lambda i: F.get(p, F.lit(i)) != F.get(q, F.lit(i))
        return (
            F.when(shape(SHA), "sha-pin")
            .when(shape(CALVER), "calver")
            .when(shape(PRERELEASE), "prerelease")
            .when(p.isNull() | q.isNull(), "unknown")
            .when(differ(0), "major")
            .when(differ(1), "minor")
            .when(differ(2), "patch")
            .otherwise("unknown")
        )

    pair = F.struct(normalise_version(old).alias("a"), normalise_version(new).alias("b"))
    parts = lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), release(v["a"]).alias("p"), release(v["b"]).alias("q"))
    return F.when(col(old).isNull() | col(new).isNull(), "unknown").otherwise(let(let(pair, parts), tier))


#: The same grammar with a group for each part.
PEP_PARTS = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?"
    r"(?:[-_.]?(dev)[-_.]?([0-9]*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_NUMBER = "decimal(38,0)"


def version_key(c: Column | str) -> Column:
    """A sort key. Versions of PEP 440 come first, in its order; others by their alternating numbers and texts, then as they are.

    Numbers of more than 38 digits count as null, which sorts first.
    """
    number = lambda x: F.when(x != "", x.try_cast(_NUMBER)).otherwise(F.lit(0).cast(_NUMBER))
    none = lambda n: F.lit(n).cast(_NUMBER)
    piece = lambda first, x: F.struct(F.when(x.rlike("^[0-9]+$"), first).otherwise(1 - first).alias("kind"), F.when(x.rlike("^[0-9]+$"), x.try_cast(_NUMBER)).alias("number"), F.when(~x.rlike("^[0-9]+$"), x).alias("text"))

    def pep(v: Column) -> Column:
        g = lambda i: F.regexp_extract(v, PEP_PARTS, i)
        pre, is_dev = g(3), g(8) != ""
        post = F.when(g(5) != "", number(g(5))).when(g(6) != "", number(g(7))).otherwise(none(-1))
        rank = F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3).when((g(5) == "") & (g(6) == "") & is_dev, 0).otherwise(4)
        local = F.transform(F.filter(F.split(g(10), "[-_.]"), lambda x: x != ""), lambda x: piece(1, x))
        release = F.transform(F.split(F.regexp_replace(g(2), r"(\.0+)+$", ""), r"\."), number)
        return F.struct(none(0).alias("other"), number(g(1)).alias("epoch"), release.alias("release"), rank.alias("pre"), number(g(4)).alias("pre_no"), post.alias("post"), F.when(is_dev, number(g(9))).otherwise(none(str(10**37))).alias("dev"), local.alias("local"), F.lit("").alias("text"))

    def other(v: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(v, F.lit("([0-9]+|[^0-9]+)"), 1), lambda x: piece(0, x))
        return F.struct(none(1).alias("other"), none(0).alias("epoch"), F.array().cast(f"array<{_NUMBER}>").alias("release"), F.lit(0).alias("pre"), none(0).alias("pre_no"), none(0).alias("post"), none(0).alias("dev"), parts.alias("local"), v.alias("text"))

    return let(F.lower(normalise_version(c)), lambda v: F.when(v.rlike(PEP_PARTS), pep(v)).when(v.isNotNull(), other(v)))
