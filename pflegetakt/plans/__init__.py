"""Staffing rules composed of the operators."""
