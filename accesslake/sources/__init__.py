"""Readers and writers of logs, tables, reports and model descriptions."""
