"""Snapshots, language tables and ground-truth files."""

from weftline.sources.languages import load_languages
from weftline.sources.snapshots import WorkspaceSource, diff, snapshot
from weftline.sources.truth import discover, symbol_tree, whole_texts

__all__ = ["WorkspaceSource", "diff", "discover", "load_languages", "snapshot", "symbol_tree", "whole_texts"]
