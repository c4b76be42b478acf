"""Checks of names and exit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of columns and tables, of events (dotted), of error classes.
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
EVENT_NAME = r"^[a-z0-9_]+(\.[a-z0-9_]+)+$"
CLASS_NAME = "^[a-z0-9_]+$"


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def is_identifier(c: Column) -> Column:
    return _matches(c, IDENTIFIER)


def is_event_name(c: Column) -> Column:
    return _matches(c, EVENT_NAME)


def is_class_name(c: Column) -> Column:
    return _matches(c, CLASS_NAME)


def exit_error(code: Column, turns_left: Column) -> Column:
    """Error class of a model backend's process: out of turns is a limit, any other non-zero exit the backend's; null where it succeeded."""
    return F.when(code == 0, F.lit(None).cast("string")).when(turns_left <= 0, "agent_limit").otherwise("agent_backend")
