"""Readers, writers and their contracts."""
