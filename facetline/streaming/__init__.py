"""Streaming: an index that follows its folder."""
