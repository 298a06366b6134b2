"""Every query of the library on the driver's tables, with SQL that checks it."""

from __future__ import annotations

from rankflow.catalog import base, reports, scalars, sketches, streams, synthetic  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
