"""Counters and state over streams of hook events, each with a batch equivalent."""
