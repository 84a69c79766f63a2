"""Micro-batch variant of the use-before-introduction detector."""
