"""Readers of tables, rule files and folders of papers."""
