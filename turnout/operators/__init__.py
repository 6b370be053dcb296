"""Reusable DataFrame operators for attendance data."""
