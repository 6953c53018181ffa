"""Operators over citation, source and result tables."""
