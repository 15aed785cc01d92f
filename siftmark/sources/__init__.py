"""Scans and sinks; every schema is declared."""
