"""Readers, writers and the scanner / detector extension points."""
