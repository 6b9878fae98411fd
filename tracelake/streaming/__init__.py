"""Incremental front for the stateless text detectors."""
