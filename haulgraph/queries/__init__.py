"""Registry of the library's own queries and the SQL they are held against."""

from __future__ import annotations

from . import analytics, composites, domain, geometry, network, relational, scalars, storage, supply, tracking  # noqa: F401
from .network import routing_fixpoint as flagship  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
