"""Whole plans."""
