"""Readers that turn text, logs and tables into long-form DataFrames."""
