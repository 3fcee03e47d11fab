"""Readers and writers: STAR tables, volumes, coordinate lists."""
