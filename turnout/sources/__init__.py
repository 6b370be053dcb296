"""Readers that give the three source tables, and writers for results."""
