"""Sinks: the export formats and the export ledger."""
