"""Readers and writers of recorded frames, catalogues and tile archives."""
