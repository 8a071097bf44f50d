"""Sinks: documents that many tasks write, tables that are changed in place."""
