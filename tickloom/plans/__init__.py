"""Whole jobs: load, export, result output, ad-hoc SQL."""
