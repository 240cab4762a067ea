"""Manifest and lockfile paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

#: Fixed values, in the order in which ecosystems are tried: the files each one owns, and which of them are lockfiles.
MANIFESTS = {
    "maven": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "npm": ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"),
    "cargo": ("Cargo.toml", "Cargo.lock"),
    "pip": ("pyproject.toml", "Pipfile", "Pipfile.lock", "poetry.lock"),
    "go": ("go.mod", "go.sum"),
}
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Pipfile.lock", "poetry.lock", "go.sum")
ECOSYSTEMS = tuple(MANIFESTS)
STUBS = ("build.gradle", "build.gradle.kts")
#: requirements*.txt, of the file name or of the whole path; the star takes slashes too.
REQUIREMENTS = r"(?s)^requirements.*\.txt$"


def slashed(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def basename(c: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(slashed(c), r"/+$", ""), "/", -1)


def dirname(c: Column | str) -> Column:
    """The path's folder without a slash at its end; '.' for a bare name."""
    p = col(c)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def strip_diff_path(c: Column | str) -> Column:
    """a/x and b/x are x; /dev/null stays."""
    return F.regexp_replace(col(c), r"^[ab]/", "")


def ecosystem(c: Column | str) -> Column:
    """The ecosystem that owns a path, or null."""
    name = basename(c)
    out = None
    for eco, names in MANIFESTS.items():
        own = name.isin(*names)
        if eco == "pip":
            own |= name.rlike(REQUIREMENTS) | slashed(c).rlike(REQUIREMENTS)
        out = F.when(own, eco) if out is None else out.when(own, eco)
    return out


def is_manifest(c: Column | str) -> Column:
    return ecosystem(c).isNotNull()


def is_lockfile(c: Column | str) -> Column:
    return basename(c).isin(*LOCKFILES)


def is_stub(c: Column | str) -> Column:
    """Lockfiles and Gradle files: files from which no change need come."""
    return is_lockfile(c) | basename(c).isin(*STUBS)


def ecosystems(files: Column | str) -> Column:
    """The distinct ecosystems of an array of structs with a path, in the order they come; empty if none."""
    return F.array_distinct(F.filter(F.transform(col(files), lambda f: ecosystem(F.coalesce(f["path"], F.lit("")))), lambda e: e.isNotNull()))
