"""Relational operators the staffing plans are made of."""
