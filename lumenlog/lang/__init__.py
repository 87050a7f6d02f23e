"""The rule language: syntax tree, lexer, parser, imports and diagnostics."""
