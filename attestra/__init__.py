"""Evidence reconciliation on Spark: the public names, loaded when they are first used."""

from __future__ import annotations

from importlib import import_module

#: Public name to the module that holds it.
_HOMES = {
    "run": "plans.engine", "run_batch": "plans.engine", "extract_sources": "plans.engine", "resolve_evidence": "plans.engine", "merge": "operators.resolve",
    "canonical_view": "plans.projection", "project": "plans.projection", "validate": "plans.projection", "clusters": "operators.cluster",
    "normalize_all": "operators.evidence", "shaped": "operators.evidence", "ADAPTERS": "sources.files",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
