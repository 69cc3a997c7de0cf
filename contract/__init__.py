"""Binding of the test tables to the football domain, registered queries and their SQL oracles."""
