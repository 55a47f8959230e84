"""Spark jobs for audio-signal corpora."""
