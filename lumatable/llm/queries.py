"""Queries of this subpackage by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from lumatable.llm import history, packing, percentiles, pii, survivors, tokens

QUERIES = {
    "p2_percentiles": percentiles.quality_percentiles,
    "p5_found": history.found,
    "p6_found": survivors.found,
    "p8_ids": tokens.ids,
    "p9_containers": packing.containers,
    "p9_constraints": packing.constraints,
    "p10_found": pii.found,
    "p10_redacted": pii.redacted,
}

SQL: dict[str, str] = {name: text() for m in (percentiles, history, survivors) for name, text in m.SQL.items()}
