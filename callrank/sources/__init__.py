"""Readers (S1-S5, S11) and writers."""
