"""Readers and writers: tolerant JSON lines, HTML folders, N-Triples and a Turtle subset, paged replays, sinks."""
