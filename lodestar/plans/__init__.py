"""Registered queries and the SQL that says the same."""

from . import catalog, census, proofs, readers, runs, scripts

__all__ = ["catalog", "census", "proofs", "readers", "runs", "scripts"]
