"""Whole queries over the tables, and the SQL that each must agree with."""
