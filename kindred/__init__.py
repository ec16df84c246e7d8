"""Entity matching and data integration on Spark DataFrames."""

from kindred.session import get_session, workspace

__all__ = ["get_session", "workspace"]
