"""Named queries over the TPC-H-like tables, each with its SQL counterpart."""

from __future__ import annotations

from framecloud.catalog.registry import QUERIES, SQL

from framecloud.catalog import (  # noqa: E402, F401  (registration happens on import)
    builds,
    checks,
    clouds,
    colors,
    parity,
    rasters,
    samples,
    stereo,
    timings,
)

__all__ = ["QUERIES", "SQL"]
