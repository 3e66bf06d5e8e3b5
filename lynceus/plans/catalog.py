"""Name -> query, and name -> the same query as SQL."""

from __future__ import annotations

from lynceus.plans import documents, landed, relational, services
from lynceus.plans.common import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "documents", "landed", "relational", "services"]

FLAGSHIP = "dgs_top_tiered"
