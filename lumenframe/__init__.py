"""Spark jobs over imaging archives, their volumes, masks and annotations."""
