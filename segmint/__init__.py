"""segmint: keyed audience profiles on Spark.

Profiles (an id with a set of segments and a score) are read from tables and
message topics, looked up by key or key list, enriched and merged with new
segment sets, and kept current by Structured Streaming jobs that upsert keyed
tables.  Everything is DataFrame / SQL / Structured Streaming.
"""

from .session import build_session, fresh_dir, shared_root

__all__ = ["build_session", "fresh_dir", "shared_root"]
