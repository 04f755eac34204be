"""Readers: delimited quotes and releases, gap reports, tables."""
