"""Identity analytics over camera observation tables, built on Spark DataFrames."""

from sightweave.config import ReconcileConfig
from sightweave.session import build_session

__all__ = ["ReconcileConfig", "build_session"]
