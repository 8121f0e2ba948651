"""Readers and writers at the edge: text runs, OFX, ledgers, CSV, workbooks."""
