"""Streaming ratings."""
