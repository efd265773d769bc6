"""Paths as users write them."""

from __future__ import annotations

import os


def resolve(path: str, base: str) -> str:
    """An absolute path: quotes and blanks at the ends go, ``~`` is the home folder, relative paths start at ``base``; paths of a
    store (scheme://) stay as they are."""
    path = path.strip().strip("\"'").strip()
    if "://" in path:
        return path
    return os.path.normpath(os.path.join(base, os.path.expanduser(path)))
