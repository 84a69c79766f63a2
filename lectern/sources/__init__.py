"""Readers and writers of course artifacts."""
