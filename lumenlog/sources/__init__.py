"""Where input relations come from, and where results go."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> dict[str, Callable]:
    """The providers by name; each makes a source from its configuration."""
    from .ast_source import AstSource
    from .clock import ClockSource
    from .csv_source import CsvSource
    from .fs import FsSource
    from .git import GitSource
    from .parquet import ParquetSource
    from .sql import SqlSource

    return {"csv": CsvSource, "fs": FsSource, "ast": AstSource, "git": GitSource, "clock": ClockSource, "sql": SqlSource, "parquet": ParquetSource}
