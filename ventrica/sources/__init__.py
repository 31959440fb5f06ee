"""Readers that turn files into rows."""
