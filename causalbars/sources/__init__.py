"""Readers, writers and the bar / news / lifecycle tables built on them."""
