"""Whole plans: named queries over the tables of a folder, and the rounds of a walk."""
