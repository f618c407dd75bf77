"""Spreadsheet and document analytics for Spark DataFrames."""
