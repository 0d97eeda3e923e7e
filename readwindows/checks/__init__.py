"""Registered queries and the plain SQL they are checked against."""
