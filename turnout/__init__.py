"""Attendance analytics on Spark: who took part in which event, when and where."""

from turnout.operators.attendance import AttendanceModel, build_attendance
from turnout.operators.periods import last_years, period_suffix
from turnout.sources.tables import Sources, read_delimited, read_tables

__all__ = [
    "AttendanceModel",
    "Sources",
    "build_attendance",
    "last_years",
    "period_suffix",
    "read_delimited",
    "read_tables",
]
