"""Operators on tables: selection, entry ranges, steps, flattening, histograms."""
