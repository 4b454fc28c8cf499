"""Queries of the library by name, with SQL for each that SQL can express."""

from __future__ import annotations

from . import context, evidence, overlays, panels, spatial, tabular

QUERIES = {**spatial.QUERIES, **context.QUERIES, **overlays.QUERIES, **tabular.QUERIES, **panels.QUERIES, **evidence.QUERIES}
ORACLES = {**spatial.ORACLES, **context.ORACLES, **overlays.ORACLES, **tabular.ORACLES, **panels.ORACLES, **evidence.ORACLES}
FLAGSHIP = spatial.building_floor_by_cell
