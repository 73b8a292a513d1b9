"""What readers of source files find, whatever the language."""

from __future__ import annotations

import hashlib
from typing import NamedTuple


class Symbol(NamedTuple):
    """A row of SYMBOLS."""

    file_path: str
    symbol_name: str | None
    qualified_name: str | None
    symbol_type: str | None
    parent_class: str | None
    signature: str | None
    docstring: str | None
    start_line: int | None
    end_line: int | None
    complexity: int | None
    is_public: bool | None
    is_entrypoint: bool | None
    parameters: list[str] | None
    raw_code: str | None
    content_hash: str | None
    error: str | None


SYMBOLS = """file_path string, symbol_name string, qualified_name string, symbol_type string, parent_class string, signature string,
 docstring string, start_line int, end_line int, complexity int, is_public boolean, is_entrypoint boolean, parameters array<string>, raw_code string, content_hash string, error string"""
CALLS = "caller_file string, caller_name string, callee_name string"
IMPORTS = "importer_file string, module string"


def hashed(code: str) -> str:
    return hashlib.sha256(code.encode("utf-8", "replace")).hexdigest()[:16]
