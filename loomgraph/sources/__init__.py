"""Readers and versioned writers."""
