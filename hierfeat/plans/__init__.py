"""Whole jobs: feature build, learning preparation, scoring."""
