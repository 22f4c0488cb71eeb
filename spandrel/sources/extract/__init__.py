"""Extractors: a source file in, facts about it out. ``extract(lang, source, rel)`` picks the one for a language."""

from __future__ import annotations

from .base import Facts


def extract(lang: str, source: str, rel: str) -> Facts:
    """Facts of one file; a file that cannot be read as its language yields its module and an error fact."""
    from . import cpp, python, rust, script

    known = {"python": python.parse, "rust": rust.parse, "cpp": cpp.parse, "typescript": script.parse_typescript, "javascript": script.parse_javascript}
    return known[lang](source, rel)
