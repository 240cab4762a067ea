"""The five labels of a change, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import paths
from .text import col

DIMENSIONS = ("source", "semver_tier", "security", "direct_transitive", "outcome")
#: Accounts known to be bots.
BOTS = (
    "pyup-bot",
    "pre-commit-ci",
    "whitesource-bolt-for-github",
    "snyk-bot",
    "mend-for-github-com",
    "restyled-io",
    "github-actions",
    "imgbot",
    "allcontributors",
)
#: Patterns of logins, advisories and titles.
DEPENDABOT = r"(?i)\Adependabot(\[bot\])?\z"
RENOVATE = r"(?i)\A(renovate|renovate-bot)(\[bot\])?\z"
BOT_SUFFIX = r"(?i)\[bot\]$"
ADVISORY = r"(?i)(GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}|CVE-\d{4}-\d{4,})"
SUPERSEDED = r"[Ss]uperseded by #\d+"
NAME_BOUND = r"[A-Za-z0-9_.\-/]"


def _login(login: Column, kind: Column | None = None) -> Column:
    bare = F.regexp_replace(F.lower(login), r"\[bot\]$", "")
    out = F.when(login.rlike(DEPENDABOT), "dependabot").when(login.rlike(RENOVATE), "renovate")
    if kind is not None:
        out = out.when(F.lower(F.coalesce(kind, F.lit(""))) == "bot", "other-bot")
    return out.when(login.rlike(BOT_SUFFIX) | bare.isin(*BOTS), "other-bot").otherwise("human")


def source(actor: Column | str, author: Column | str, author_type: Column | str) -> Column:
    """dependabot, renovate, other-bot or human. The author counts, or else the actor, whose type is not known."""
    a, b = col(author), col(actor)
    return F.when(F.coalesce(a != "", F.lit(False)), _login(a, col(author_type))).when(F.coalesce(b != "", F.lit(False)), _login(b)).otherwise("human")


def _texts(*cs: Column | str) -> Column:
    """Texts that are not empty, a line each."""
    return F.concat_ws("\n", *(F.nullif(col(c), F.lit("")) for c in cs))


def security(title: Column | str, body: Column | str, commits: Column | str) -> Column:
    return F.when(_texts(title, body, commits).rlike(ADVISORY), "security").otherwise("non-security")


def mentions(package: Column | str, title: Column | str, body: Column | str) -> Column:
    """Whether the texts name the package, its part after the last colon, or either with '-' and '_' swapped, as a whole name."""
    p, text = F.lower(col(package)), _texts(title, body)
    forms = F.array_distinct(F.array(p, F.substring_index(p, ":", -1), F.translate(p, "_", "-"), F.translate(p, "-", "_")))
    quoted = lambda f: F.concat(F.lit(f"(?i)(?<!{NAME_BOUND})\\Q"), F.replace(f, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{NAME_BOUND})"))
    return F.coalesce(F.exists(forms, lambda f: (f != "") & F.rlike(text, quoted(f))), F.lit(False))


def beside_manifest(manifest_path: Column | str, files: Column | str, eco: Column | str) -> Column:
    """Whether a manifest of the same ecosystem, not a lockfile, changed in the same folder."""
    here, e = paths.dirname(manifest_path), col(eco)
    hit = lambda f: (paths.ecosystem(f["path"]) == e) & ~paths.is_lockfile(f["path"]) & (paths.dirname(f["path"]) == here)
    return F.coalesce(F.exists(col(files), lambda f: F.coalesce(hit(f), F.lit(False))), F.lit(False))


def direct_transitive(is_lockfile: Column | str, sibling: Column | str, package: Column | str, title: Column | str, body: Column | str, manifest_path: Column | str, files: Column | str, eco: Column | str) -> Column:
    """direct for manifest rows, for lockfile rows whose package a manifest of the same pull request changes (sibling), and where texts and files say so."""
    known = F.coalesce(col(package) != "", F.lit(False)) & F.coalesce(col(eco) != "", F.lit(False))
    told = known & beside_manifest(manifest_path, files, eco) & mentions(package, title, body)
    return F.when(~F.coalesce(col(is_lockfile), F.lit(False)), "direct").when(F.coalesce(col(sibling), F.lit(False)), "direct").when(told, "direct").otherwise("transitive")


def outcome(state: Column | str, merged: Column | str, title: Column | str, body: Column | str, comment_reason: Column | str | None = None) -> Column:
    """struct(label, reason): merged, open, superseded (title_body or the comment's reason), closed-unmerged or unknown."""
    s = F.lower(F.coalesce(col(state), F.lit("")))
    said = _texts(title, body).rlike(SUPERSEDED)
    reason = F.lit(None).cast("string") if comment_reason is None else col(comment_reason)
    closed = s == "closed"
    m = F.coalesce(col(merged), F.lit(False))
    label = F.when(m, "merged").when(s == "open", "open").when(closed & (said | reason.isNotNull()), "superseded").when(closed, "closed-unmerged").otherwise("unknown")
    why = F.when(~m & closed & said, "title_body").when(~m & closed, reason)
    return F.struct(label.alias("label"), why.alias("reason"))
