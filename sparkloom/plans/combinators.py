"""A registry of named functions and the combinators that compose jobs from them: lazy until a result is asked for."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

_functions: dict[str, Callable] = {}


def task(f: Callable) -> Callable:
    """Registers f under its name; arguments may be DataFrames, lists of them, None or plain values."""
    for p in inspect.signature(f).parameters.values():
        if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
            raise TypeError(f"{f.__name__}: variable arguments can't be registered")
    _functions[f.__name__] = f
    return f


class Handle:
    """A task's future result; it runs once, after what it depends on."""

    def __init__(self, f: Callable, args: Sequence, kwargs: dict, after: Sequence[Handle] = ()):
        self._call, self._after, self._done, self._value = (f, args, kwargs), after, False, None

    def result(self) -> Any:
        if not self._done:
            for h in self._after:
                h.result()
            f, args, kwargs = self._call
            self._value, self._done = f(*map(_value, args), **{k: _value(v) for k, v in kwargs.items()}), True
        return self._value


def _value(x: Any) -> Any:
    if isinstance(x, Handle):
        return x.result()
    return [_value(y) for y in x] if isinstance(x, list) else x


def _find(f: str | Callable) -> Callable:
    return _functions[f] if isinstance(f, str) else f


def spawn(f: str | Callable, *args, **kwargs) -> Handle:
    return Handle(_find(f), args, kwargs)


def then(f: str | Callable, *args, **kwargs) -> Handle:
    """A continuation: handles among the arguments are its data dependencies."""
    return Handle(_find(f), args, kwargs)


def sink(f: str | Callable, *args, after: Sequence[Handle], **kwargs) -> Handle:
    """Runs after other tasks without their results."""
    return Handle(_find(f), args, kwargs, after)


def fold(f: Callable[[Any, Any], Any], parts: list) -> Handle:
    """Combines results pairwise, as a balanced tree."""

    def run(values: list) -> Any:
        if not values:
            raise ValueError("nothing to fold")
        while len(values) > 1:
            values = [f(*values[i : i + 2]) if i + 1 < len(values) else values[i] for i in range(0, len(values), 2)]
        return values[0]

    return Handle(run, (parts,), {})


def run(name: str, **kwargs) -> DataFrame:
    """Runs a registered function by name."""
    return _functions[name](**kwargs)
