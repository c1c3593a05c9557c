"""Sketches kept up to date over a stream."""
