"""Structured Streaming forms of the note fold and the session gate."""
