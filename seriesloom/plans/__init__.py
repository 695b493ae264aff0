"""Registered queries and the SQL that each is checked against."""
