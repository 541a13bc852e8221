"""Operators: functions from DataFrames to DataFrames, parametrised by column names."""
