"""Folioforge: streaming."""
