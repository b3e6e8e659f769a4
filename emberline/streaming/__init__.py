"""Streaming form of the pipeline."""
