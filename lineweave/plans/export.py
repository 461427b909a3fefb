"""Named steps over lines: macros and export filters, run in order of priority."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lineweave.operators.windows import fold

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """Export filters by unique name; higher priorities run first."""

    def __init__(self) -> None:
        self.filters: dict[str, tuple[int, Step]] = {}

    def add(self, name: str, step: Step, priority: int = 0) -> None:
        if name in self.filters:
            raise ValueError(f"{name} is registered already")
        self.filters[name] = (priority, step)

    def add_macro(self, name: str, run: Callable, schema, priority: int = 0) -> None:
        """A Python function from one file's lines (pandas) to its new lines."""
        self.add(name, lambda lines: fold(lines, run, schema or lines.schema), priority)

    def names(self) -> list[str]:
        return sorted(self.filters, key=lambda n: (-self.filters[n][0], n))

    def export(self, lines: DataFrame, chosen: list[str] | None = None, writer: Step | None = None) -> DataFrame:
        for name in self.names():
            if chosen is None or name in chosen:
                lines = self.filters[name][1](lines)
        return writer(lines) if writer else lines
