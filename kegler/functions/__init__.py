"""Geometry and colour as column expressions."""
