"""Registered queries and the tables they run on."""
