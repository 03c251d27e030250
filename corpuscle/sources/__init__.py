"""Readers, reference lists and generated samples."""
