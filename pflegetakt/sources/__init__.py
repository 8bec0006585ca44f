"""Readers of the delimited input files and the writer of the reports."""
