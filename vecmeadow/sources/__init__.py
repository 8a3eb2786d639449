"""Readers and table-backed stores."""
