"""Decoders for the tests of the document source: a line of a file is a token."""

from __future__ import annotations

import os
import uuid


def words(content):
    if content.startswith(b"broken"):
        raise ValueError("not a document")
    if content.startswith(b"scan:"):
        return None
    return [(1, 10.0 * i, 5.0, 1.0, t) for i, t in enumerate(content.decode().split())]


def engine():
    """Each engine has a name of its own; the worker's number tells workers apart."""
    return f"{os.getpid()}-{uuid.uuid4().hex}"


def recognise(content, made):
    return [(2, 0.0, 0.0, 0.5, made)] if content.startswith(b"scan:") else None
