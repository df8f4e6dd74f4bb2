"""Recording-library analytics on Spark: every operator maps DataFrames to DataFrames."""

from footlamp.session import get_session

__all__ = ["get_session"]
