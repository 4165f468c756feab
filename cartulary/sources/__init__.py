"""Readers: files and pages, JSON lines, manifests, run folders, configuration."""
