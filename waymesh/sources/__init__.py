"""Readers and writers of road networks, path caches and route requests."""
