"""Column-level building blocks: rule tables, pattern groups and text functions."""
