"""Relational operators on pages, lines, jobs and dumps."""
