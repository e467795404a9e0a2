"""Knowledge graph and time series on Spark: graph patterns, k-hop expansion, series retrieval, ingestion, derived series."""

from .engine import Engine
from .session import session
from .vocab import Vocabulary

__all__ = ["Engine", "Vocabulary", "session"]
