"""Structured Streaming over the scoring log and over arriving feature rows."""
