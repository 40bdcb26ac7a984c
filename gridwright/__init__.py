"""Spark-native reformatting, averaging, splitting and joining of monitoring time series."""

from gridwright.session import build_session, use_engine_settings

__all__ = ["build_session", "use_engine_settings"]
__version__ = "0.1.0"
