"""Every registered query of the raster engine, and its SQL twin."""

from __future__ import annotations

from glintfield.plans import focus, geometry, mapping, rasters, spectra, state, tables

QUERIES: dict = {**geometry.QUERIES, **spectra.QUERIES, **focus.QUERIES, **tables.QUERIES, **rasters.QUERIES, **state.QUERIES, **mapping.QUERIES}
ORACLE_SQL: dict[str, str] = {**geometry.ORACLE_SQL, **spectra.ORACLE_SQL, **focus.ORACLE_SQL, **tables.ORACLE_SQL, **rasters.ORACLE_SQL, **state.ORACLE_SQL, **mapping.ORACLE_SQL}
FLAGSHIP = "color_fast_time"
