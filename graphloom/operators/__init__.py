"""Relational and graph operators: functions from DataFrames to DataFrames."""
