"""Requests as streams."""
