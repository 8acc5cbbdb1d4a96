"""Relational operators over segment, unit, translation, score and record tables."""
