"""Layers, their configuration, and the registered queries."""
