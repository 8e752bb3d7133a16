"""Code-graph analytics as DataFrame plans.

The names of PUBLIC can be imported from here; each loads its module when first used, so
workers that only parse don't load the plans.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

__version__ = "0.1.0"

PUBLIC = {
    "codeloom.plans.project": ("init_project", "index_project", "sync_project", "open_project", "project_status", "query_project", "impact_project", "explain_project", "sample_project", "viewer_graph", "build"),
    "codeloom.plans.reports": ("snippet",),
    "codeloom.plans.lang": ("parse", "QueryError"),
    "codeloom.sources.scan": ("scan",),
    "codeloom.sources.parsers.registry": ("parse_files", "parse_source", "register"),
    "codeloom.model": ("Graph", "SCHEMAS"),
    "codeloom.serve": ("start",),
    "codeloom.streaming": ("sync_stream",),
}
_HOME = {name: module for module, names in PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module 'codeloom' has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
