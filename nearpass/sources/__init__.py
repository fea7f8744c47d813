"""Readers: landed files, message streams and tables to typed rows."""
