"""Options of the pipelines, validated once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from palisade.allowlists import KNOWN_INSTALL_SCRIPTS, POPULAR_NPM, POPULAR_PYPI
from palisade.schema import ADVISORY_TTL_MS, ECOSYSTEMS, METADATA_TTL_MS, MOST_ADVISORY_TTL_MS, MOST_METADATA_TTL_MS, SEVERITIES

VALID_ECOSYSTEMS = tuple(e for e, *_ in ECOSYSTEMS)
#: Keys that a merge of option trees leaves out.
UNSAFE_KEYS = ("__proto__", "constructor", "prototype")


@dataclass(frozen=True)
class Options:
    """``least_severity`` is the mildest one that is reported; ``switched_off`` are signals that aren't computed.

    With ``as_of_version`` a package's signals are those of the version in use, as it was when it was the latest; without, of the latest one now."""

    ecosystems: tuple[str, ...] = tuple(e for e in VALID_ECOSYSTEMS if e != "brew")
    least_severity: str = "MODERATE"
    switched_off: tuple[str, ...] = ()
    advisory_ttl_ms: int = ADVISORY_TTL_MS
    metadata_ttl_ms: int = METADATA_TTL_MS
    verbose: bool = False
    deep: bool = False
    force: bool = False
    any_age: bool = False
    as_of_version: bool = False
    narrow_lookup: bool = False
    popular_npm: tuple[str, ...] = tuple(POPULAR_NPM)
    popular_pypi: tuple[str, ...] = tuple(POPULAR_PYPI)
    known_install_scripts: tuple[str, ...] = tuple(KNOWN_INSTALL_SCRIPTS)
    warnings: tuple[str, ...] = field(default=(), compare=False)


def validated(ecosystem: str | None = None, ecosystems: list[str] | None = None, severity: str | None = None, **given) -> Options:
    """Options from given values. An unknown ``ecosystem`` raises, for it would scan nothing and look clean; unknown ones in the list
    ``ecosystems`` are left out with a warning, and raise if none is left. An unknown severity becomes the default one. Ages that
    entries of caches may have are bounded."""
    warnings, out = [], Options(**given)
    if ecosystem is not None:
        if ecosystem.lower() not in VALID_ECOSYSTEMS:
            near = next((e for e in VALID_ECOSYSTEMS if abs(len(e) - len(ecosystem)) <= 1 and sum(a != b for a, b in zip(e, ecosystem.lower(), strict=False)) <= 2), None)
            raise ValueError(f"unknown ecosystem {ecosystem!r}" + (f", did you mean {near!r}?" if near else f"; valid ones: {', '.join(VALID_ECOSYSTEMS)}"))
        out = replace(out, ecosystems=(ecosystem.lower(),))
    elif ecosystems is not None:
        fine = tuple(e for e in ecosystems if e in VALID_ECOSYSTEMS)
        if not fine:
            raise ValueError("no valid ecosystems")
        if len(fine) < len(ecosystems):
            warnings.append("unknown ecosystems are left out")
        out = replace(out, ecosystems=fine)
    if severity is not None:
        if severity.upper() in {s for s, _, _ in SEVERITIES}:
            out = replace(out, least_severity=severity.upper())
        else:
            warnings.append(f"unknown severity {severity!r}")
    return replace(out, advisory_ttl_ms=min(out.advisory_ttl_ms, MOST_ADVISORY_TTL_MS), metadata_ttl_ms=min(out.metadata_ttl_ms, MOST_METADATA_TTL_MS), warnings=tuple(warnings))


def merged(low: dict, high: dict) -> dict:
    """A deep merge; ``high`` wins, unsafe keys are left out."""
    out = {k: v for k, v in low.items() if k not in UNSAFE_KEYS}
    for k, v in high.items():
        if k not in UNSAFE_KEYS:
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
