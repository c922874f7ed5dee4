"""Folioforge: operators."""
