"""Streaming of folioforge."""
