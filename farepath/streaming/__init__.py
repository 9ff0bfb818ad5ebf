"""Incremental runs of the count questions with Structured Streaming.

The questions are batch questions; this package only lets the same
operators run over a folder that keeps receiving trip files, with the
grouped counts kept in the streaming state store.
"""

from farepath.streaming.incremental import run_available, stream_files

__all__ = ["run_available", "stream_files"]
