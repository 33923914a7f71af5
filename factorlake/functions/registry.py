"""Names of factors, indicators, screens and rules. A name is given once."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """name -> function; used as a decorator: @FACTORS("name")."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def __call__(self, *names: str) -> Callable:
        def add(f: Callable) -> Callable:
            for name in names:
                if name in self:
                    raise ValueError(f"{self.kind} {name} is registered already")
                self[name] = f
            return f

        return add

    def find(self, name: str) -> Callable:
        if name not in self:
            raise ValueError(f"no {self.kind} {name}; there are: {', '.join(sorted(self))}")
        return self[name]

    def info(self) -> list[tuple[str, str]]:
        return [(k, (f.__doc__ or "").strip().split("\n")[0]) for k, f in sorted(self.items())]


#: DataFrame and parameters -> DataFrame with the factor's column, named after it.
FACTORS = Registry("factor")
#: DataFrame and parameters -> DataFrame with the indicator's columns.
INDICATORS = Registry("indicator")
#: Panel and parameters -> signal rows.
SCREENS = Registry("screen")
#: Parameters -> Boolean Column that is true where a signal is rejected.
RULES = Registry("rule")
