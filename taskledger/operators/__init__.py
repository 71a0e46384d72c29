"""Operators on task and key tables. Each takes DataFrames and returns DataFrames."""
