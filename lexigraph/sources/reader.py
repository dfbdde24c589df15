"""Choosing a reader by name or content, and reading files."""

from __future__ import annotations

import json
import os
import re

from ..errors import EngineError
from . import records, turtle
from .rdf import MAX_BYTES, Graph

ARRAY = re.compile(r"\s*\[\s*(?:\Z|\{|\]\s*\Z)")


def sniff(text: str) -> str:
    """turtle, json, jsonl or snapshot, by the first characters; a bracket may also begin a Turtle blank node."""
    text = text.removeprefix("﻿")
    if ARRAY.match(text):
        return "json"
    if not text.lstrip().startswith("{"):
        return "turtle"
    try:
        value = json.loads(text)
    except ValueError:
        return "jsonl"
    return "snapshot" if isinstance(value, dict) and isinstance(value.get("synonyms"), dict) else "jsonl"


def read_source(text: str, format: str | None = None, base: str = "") -> Graph | dict:
    """The graph of a source, or the object of a snapshot."""
    if len(text) > MAX_BYTES // 4 and len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise EngineError(2, "Source exceeds 256 MiB input limit")
    kind = sniff(text) if format in (None, "", "auto") else format
    if kind in ("turtle", "ttl"):
        return turtle.read(text, base)
    if kind in ("json", "jsonl"):
        return records.read(text, base, kind == "jsonl")
    if kind == "snapshot":
        try:
            view = json.loads(text)
        except ValueError as e:
            raise EngineError(2, f"Invalid JSON: {e}") from None
        if not isinstance(view, dict) or not isinstance(view.get("synonyms"), dict):
            raise EngineError(2, "A snapshot requires a synonyms object")
        return view
    raise EngineError(2, f"Unsupported source format: {kind}")


def read_file(path: str) -> str:
    try:
        with open(path, "rb") as f:
            data = f.read(MAX_BYTES + 1)
    except OSError as e:
        raise EngineError(2, f"Cannot read {path}: {e.strerror}") from None
    if len(data) > MAX_BYTES:
        raise EngineError(2, "Source exceeds 256 MiB input limit")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise EngineError(2, "Source is not valid UTF-8") from None


def file_base(path: str) -> str:
    return "file://" + os.path.abspath(path)
