"""Readers: captures of frames, metric text, logs and collector dumps."""
