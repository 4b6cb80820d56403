"""Reusable column and frame functions."""
