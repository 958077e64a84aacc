"""Incremental runs: the stream's checkpoint is the record of what is done."""
