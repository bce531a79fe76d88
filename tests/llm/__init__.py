"""Tests of the operators for text corpora."""
