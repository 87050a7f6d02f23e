"""The builtin functions' argument and result types: n number, f float, s string, x number or float."""

from __future__ import annotations

BUILTINS: dict[str, tuple[str, str]] = {
    "split_nth": ("ssn", "s"),
    "starts_with": ("ss", "n"),
    "contains": ("ss", "n"),
    "str_before": ("ss", "n"),
    "replace": ("sss", "s"),
    "before_last": ("ss", "s"),
    "after_last": ("ss", "s"),
    "concat": ("ss", "s"),
    "extract_number": ("s", "n"),
    "date_epoch": ("s", "n"),
    "to_float": ("n", "f"),
    "round": ("f", "n"),
    "floor": ("f", "n"),
    "to_lower": ("s", "s"),
    "to_upper": ("s", "s"),
    "ln": ("f", "f"),
    "exp": ("f", "f"),
    "sqrt": ("f", "f"),
    "pow": ("ff", "f"),
    "abs": ("x", "x"),
    "similarity": ("ss", "n"),
}
NAMES = {"n": "number", "f": "float", "s": "string"}
