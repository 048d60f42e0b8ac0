"""Operators: functions from DataFrames to DataFrames. None collects rows or reads a clock."""
