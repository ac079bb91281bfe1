"""eventclime: event-time analytics of news events and weather readings on Spark.

Batch DataFrames and Structured Streaming sources go through the same
column expressions; see ``plans.jobs`` for the job-level entry points.
"""

from .session import build_session, prepare, scratch_path, shared_dir

__all__ = ["build_session", "prepare", "scratch_path", "shared_dir"]
