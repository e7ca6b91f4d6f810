"""Severities, CVSS base scores, and fields of advisories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.schema import SEVERITIES, SYNONYMS


def _mapped(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def order_of(severity: Column) -> Column:
    """4 for CRITICAL to 1 for LOW; null for others."""
    return _mapped(severity, {s: o for s, o, _ in SEVERITIES})


def weight_of(severity: Column) -> Column:
    """The weight in a risk score; 1 for unknown severities."""
    return F.coalesce(_mapped(severity, {s: w for s, _, w in SEVERITIES}), F.lit(1))


def canonical(severity: Column) -> Column:
    """One of the four severities from any of their names in any case; null for others."""
    upper = F.upper(severity)
    return _mapped(upper, {s: s for s, _, _ in SEVERITIES} | SYNONYMS)


def named(order: Column) -> Column:
    return _mapped(order, {o: s for s, o, _ in SEVERITIES})


def level_of(score: Column) -> Column:
    """The risk level of a score."""
    return F.when(score >= 30, "CRITICAL").when(score >= 15, "HIGH").when(score >= 5, "MODERATE").when(score > 0, "LOW").otherwise("NONE")


#: The weights of CVSS 3.1 base metrics.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR changed": {"N": 0.85, "L": 0.68, "H": 0.50},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def cvss_base_score(vector: Column) -> Column:
    """The base score of a CVSS 3.1 vector, rounded up to a tenth. With a metric missing, a guess by the attack vector."""
    metric = lambda name: F.nullif(F.regexp_extract(vector, rf"(?:^|/){name}:([^/:]+)", 1), F.lit(""))
    changed = F.coalesce(metric("S") == "C", F.lit(False))
    av, ac, ui = _mapped(metric("AV"), CVSS["AV"]), _mapped(metric("AC"), CVSS["AC"]), _mapped(metric("UI"), CVSS["UI"])
    pr = F.when(changed, _mapped(metric("PR"), CVSS["PR changed"])).otherwise(_mapped(metric("PR"), CVSS["PR"]))
    c, i, a = (_mapped(metric(m), CVSS["CIA"]) for m in "CIA")
    guess = F.when(metric("AV") == "N", 7.5).when(metric("AV") == "A", 5.0).when(metric("AV") == "L", 4.0).otherwise(5.0)
    loss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (loss - 0.029) - 3.25 * F.pow(loss - 0.02, F.lit(15.0))).otherwise(6.42 * loss)
    total = (impact + 8.22 * av * ac * pr * ui) * F.when(changed, 1.08).otherwise(1.0)
    score = F.when(impact <= 0, 0.0).otherwise(F.ceil(F.least(total, F.lit(10.0)) * 10) / 10)
    return F.when(F.coalesce(av, ac, ui, pr, c, i, a).isNotNull() & (av + ac + ui + pr + c + i + a).isNotNull(), score).otherwise(guess)


def score_bucket(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MODERATE").when(score > 0, "LOW")


def advisory_severity(database: Column, ecosystems: Column, scores: Column) -> Column:
    """An advisory's severity: the database's, else the first known one of an ecosystem, else by the highest score, else CRITICAL.

    ``ecosystems`` is an array of names, ``scores`` one of texts, each a number or a CVSS vector.
    """
    known = F.get(F.filter(F.transform(ecosystems, canonical), lambda s: s.isNotNull()), F.lit(0))
    value = lambda s: F.when(s.rlike(r"^\s*[0-9.]+\s*$"), F.expr("0.0") + F.regexp_replace(s, r"[^0-9.]", "").cast("double")).when(s.startswith("CVSS:3"), cvss_base_score(s))
    return F.coalesce(canonical(database), known, score_bucket(F.array_max(F.transform(scores, value))), F.lit("CRITICAL"))


def display_id(aliases: Column, own: Column) -> Column:
    """The first GHSA alias, else the first CVE alias, else the id itself."""
    first = lambda prefix: F.get(F.filter(aliases, lambda a: a.startswith(prefix)), F.lit(0))
    return F.coalesce(first("GHSA-"), first("CVE-"), own)


def fixed_version(affected: Column, package: Column) -> Column:
    """``>= v`` for the first fixing event of the entries for ``package``."""
    mine = F.filter(affected, lambda a: a["package"]["name"] == package)
    events = F.flatten(F.transform(mine, lambda a: F.flatten(F.transform(F.coalesce(a["ranges"], F.array()), lambda r: F.coalesce(r["events"]["fixed"], F.array())))))
    return F.concat(F.lit(">= "), F.get(F.filter(events, lambda f: f.isNotNull() & (f != "")), F.lit(0)))
