"""Operators: functions DataFrame(s) -> DataFrame, grouped by concern."""
