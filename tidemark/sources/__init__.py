"""Readers for stored tables and for tables followed as streams."""
