"""Resumable ingestion as streams of files."""
