"""Bot comments that say a pull request was superseded."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .classifiers import BOTS
from .text import col

#: Fixed values, in the order in which they are tried: bot family, pattern, reason, name.
PATTERNS = (
    ("dependabot", r"(?i)superseded by #?\d+", "comment_superseded", "dependabot_superseded_by_pr"),
    ("dependabot", r"(?i)updatable in another way", "comment_grouped", "dependabot_updatable_elsewhere"),
    ("dependabot", r"(?i)no longer needed", "comment_grouped", "dependabot_no_longer_needed"),
    ("dependabot", r"(?i)up[- ]to[- ]date now", "comment_grouped", "dependabot_up_to_date_now"),
    ("renovate", r"(?i)superseded by #?\d+", "comment_superseded", "renovate_superseded_by_pr"),
    ("renovate", r"(?i)autoclosing this pr", "comment_grouped", "renovate_autoclosing"),
    ("renovate", r"(?i)superseded", "comment_grouped", "renovate_superseded_generic"),
    ("renovate", r"(?is)renovate.*clos", "comment_grouped", "renovate_closure_generic"),
    ("other-bot", r"(?i)superseded by #?\d+", "comment_superseded", "generic_superseded_by_pr"),
    ("other-bot", r"(?i)updatable in another way|no longer needed|up[- ]to[- ]date now", "comment_grouped", "generic_grouped_or_obsolete"),
)
#: Fixed value: comments of this kind tell nothing.
EXCLUDED = r"(?i)won.?t notify you again about this release"
COMMENT = "struct<id:bigint,author_login:string,author_type:string,body:string,created_at:string>"
MATCH = "struct<reason:string,bot_family:string,pattern_name:string,comment_text:string,created_at:string>"
SHOWN = 500


def bot_family(login: Column | str, kind: Column | str) -> Column:
    name = F.lower(F.coalesce(col(login), F.lit("")))
    bare = F.regexp_replace(name, r"\[bot\]$", "")
    bot = (F.lower(F.coalesce(col(kind), F.lit(""))) == "bot") | name.endswith("[bot]") | bare.isin(*BOTS)
    return F.when(bare == "dependabot", "dependabot").when(bare.isin("renovate", "renovate-bot"), "renovate").when(bot, "other-bot").otherwise("human")


def parse_comments(c: Column | str) -> Column:
    """JSON text as an array of comments; anything but a readable array is an empty one, elements that are no objects fall out."""
    arr = F.from_json(F.when(col(c).rlike(r"^\s*\["), col(c)), f"array<{COMMENT}>")
    return F.coalesce(F.filter(arr, lambda x: x.isNotNull()), F.array().cast(f"array<{COMMENT}>"))


def comment_pattern(comment: Column) -> Column:
    """struct(reason, pattern) of the first pattern of the author's family that the comment fits, or null."""
    body, family = F.coalesce(comment["body"], F.lit("")), bot_family(comment["author_login"], comment["author_type"])
    out = F.when((body == "") | body.rlike(EXCLUDED) | (family == "human"), F.lit(None))
    for fam, pattern, reason, name in PATTERNS:
        out = out.when((family == fam) & body.rlike(pattern), F.struct(F.lit(reason).alias("reason"), F.lit(fam).alias("bot_family"), F.lit(name).alias("pattern_name")))
    return out


def supersession(comments: Column | str) -> Column:
    """The latest comment that fits, as MATCH; null if none does. comments: array of COMMENT in order of time."""
    found = F.transform(col(comments), lambda c: F.struct(comment_pattern(c).alias("m"), c.alias("c")))
    last = F.try_element_at(F.filter(found, lambda x: x["m"].isNotNull()), F.lit(-1))
    match = F.struct(last["m"]["reason"].alias("reason"), last["m"]["bot_family"].alias("bot_family"), last["m"]["pattern_name"].alias("pattern_name"), last["c"]["body"].alias("comment_text"), last["c"]["created_at"].alias("created_at"))
    return F.when(last.isNotNull(), match)


def shown(text: Column | str) -> Column:
    """At most SHOWN characters, with a note where more were left out."""
    t = col(text)
    return F.when(F.length(t) > SHOWN, F.concat(F.left(t, F.lit(SHOWN)), F.lit("...[truncated]"))).otherwise(t)
