"""Operators on tables: joins, assembly, chunking, tasks, quality, splits, statistics."""
