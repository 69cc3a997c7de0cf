"""Readers and writers for landed files, state tables and reports."""
