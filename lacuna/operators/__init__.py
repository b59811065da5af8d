"""Operators on spans and notes."""
