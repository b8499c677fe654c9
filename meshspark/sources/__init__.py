"""Readers and writers of geometry formats."""
