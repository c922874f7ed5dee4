"""Folioforge: functions."""
