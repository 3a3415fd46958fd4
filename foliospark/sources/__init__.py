"""Readers of lines, tables of contents, libraries and evaluation sets."""
