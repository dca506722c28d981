"""Operators as DataFrame -> DataFrame."""
