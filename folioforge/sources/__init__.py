"""Folioforge: sources."""
