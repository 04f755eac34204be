"""Whole jobs: loading the feeds and building the reaction tables."""
