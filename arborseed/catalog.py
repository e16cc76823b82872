"""The engine's queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

from .plans import alignments, records, tours  # noqa: F401  records registers its queries
from .plans.oracle import ORACLES as BASE_ORACLES
from .plans.queries import QUERIES as BASE_QUERIES
from .plans.records_oracle import ORACLES as RECORD_ORACLES

QUERIES = {**BASE_QUERIES, **alignments.QUERIES, **tours.QUERIES}
ORACLES = {**BASE_ORACLES, **RECORD_ORACLES, **alignments.ORACLES, **tours.ORACLES}

__all__ = ["ORACLES", "QUERIES"]
