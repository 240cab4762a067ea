"""Markdown summaries of the statistics."""

from __future__ import annotations


def _ci(value: float | None, lo: float | None, hi: float | None) -> str:
    if value is None:
        return "NA"
    return f"{value:.3f} ({lo:.3f}, {hi:.3f})" if lo is not None and hi is not None else f"{value:.3f}"


def _table(head: list[str], numeric: int, rows: list[list[object]]) -> str:
    rule = ["---"] * (len(head) - numeric) + ["---:"] * numeric
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in (head, rule, *rows))


def percentages(rows: list[dict], count: str, of: list[str]) -> list[dict]:
    """rows with <count>_percentage, of all counts with the same values in of, rounded to one digit as Python does; 0.0 where there are none."""
    totals: dict[tuple, int] = {}
    for r in rows:
        key = tuple(r[c] for c in of)
        totals[key] = totals.get(key, 0) + r[count]
    share = lambda r: round(r[count] / t * 100, 1) if (t := totals[tuple(r[c] for c in of)]) else 0.0
    return [r | {f"{count}_percentage": share(r)} for r in rows]


def effects_markdown(overall: list[dict], intervals: list[dict], pairs: list[dict]) -> str:
    """overall: cramers_v rows; intervals: bootstrap_v rows; pairs: pairwise_v rows."""
    key = lambda r: (r["dimension"], r["stratifier"], r["unit"])
    ci = {key(r): r for r in intervals}
    n = {k: sum(bool(p["substantive"]) for p in pairs if key(p) == k) for k in map(key, overall)}
    rows = [[*key(r), r["n"], _ci(r["v"], ci.get(key(r), {}).get("ci_lo"), ci.get(key(r), {}).get("ci_hi")), n[key(r)]] for r in overall]
    return _table(["dimension", "stratifier", "unit", "n", "overall V (95% CI)", "pairwise V>=0.10"], 3, rows)


def strata_markdown(strata: list[dict], intervals: list[dict]) -> str:
    """The overall row, then reportable one-way strata by mean. An empty table gives 'NA'."""
    columns = ("ecosystem", "semver_tier", "is_security_any", "source_mix")
    ci = {(r["scope"], r["stratum"]): r for r in intervals}
    rows = []
    for scope in ("overall", *columns):
        own = [r for r in strata if r["scope"] == scope and (scope == "overall" or r["reportable"])]
        for r in sorted(own, key=lambda r: r["mean"] if r["mean"] is not None else 0.0):
            c = ci.get((scope, "" if scope == "overall" else str(r[scope])), {})
            rows.append([scope if scope == "overall" else f"{scope}={r[scope]}", r["n"], _ci(r["mean"], c.get("ci_mean_lo"), c.get("ci_mean_hi")), _ci(r["median"], c.get("ci_median_lo"), c.get("ci_median_hi"))])
    return _table(["scope", "n", "mean alignment", "median alignment"], 3, rows or [["overall", 0, "NA", "NA"]])
