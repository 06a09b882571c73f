"""All registered queries: name -> function, name -> DuckDB SQL."""

from __future__ import annotations

from .queries import ORACLE, QUERIES, curation, linking, paths, reading, refs, sources, streams, text, trade  # noqa: F401

FLAGSHIP = "search_containment"
