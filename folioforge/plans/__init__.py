"""Folioforge: plans."""
