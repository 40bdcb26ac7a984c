"""Errors raised by strict checks and by configuration validation."""

from __future__ import annotations


class DataViolation(ValueError):
    """Data breaks a rule the caller asked to enforce."""


class AmbiguousDate(DataViolation):
    """A text value has more than one valid date/time reading."""
