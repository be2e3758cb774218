"""marketpulse — Spark-native analytics for market prices and financial news.

Every operator takes and returns DataFrames; the work runs as Spark jobs
(joins, grouping, windows, state).  See README.md for the operator map.
"""

from marketpulse.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
