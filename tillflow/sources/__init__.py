"""Readers, writers and the checks around them."""
