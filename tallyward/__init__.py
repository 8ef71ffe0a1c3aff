"""Healthcare-claims analytics on Spark: landing, cleaning, marts, reports, checks and streams."""

from tallyward.session import build_session

__all__ = ["build_session"]
