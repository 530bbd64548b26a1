"""All queries of the engine by name, with their SQL for comparison."""

from lodestone.queries import geometry, reports, search, store, streams, vectors  # noqa: F401
from lodestone.queries.base import ORACLES, QUERIES  # noqa: F401
