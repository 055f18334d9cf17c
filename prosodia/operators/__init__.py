"""Relational operators over time-stamped events, intervals and nested word records."""
