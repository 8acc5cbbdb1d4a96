"""Readers: files and byte columns become segment tables."""
