"""The same extraction over streams of files."""
