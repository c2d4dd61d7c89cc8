"""Registered queries, the SQL they are compared with, and the data they run on."""
