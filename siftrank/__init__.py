"""siftrank: Spark-native prioritisation of large candidate tables."""

from siftrank.options import RunOptions
from siftrank.session import get_session

__all__ = ["RunOptions", "get_session"]
