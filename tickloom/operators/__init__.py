"""Operators over tick DataFrames: filters, lookups, bars, pages, catalog."""
