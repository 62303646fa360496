"""Readers: protein, spectrum, report and text files as DataFrames."""
