"""Operators over sequences and factors."""
