"""Operators over changelog, segment, catalog and replica DataFrames."""
