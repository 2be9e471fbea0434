"""The queries of the training-text operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("encoding_repair", "main_content", "splitting", "ocr_repair", "layout_copies", "template_residue", "tokenizing", "leakage", "text_quality")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
