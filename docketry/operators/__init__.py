"""Relational, text and graph operators: functions from DataFrames to DataFrames, evaluated lazily."""
