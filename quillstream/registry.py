"""Named functions: estimators, losses, reward functions and the like."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable


class Registry:
    """name -> function; a name can't be given to two functions."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            if self._known.get(name, f) is not f:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self._known[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


ADVANTAGES = Registry("advantage estimator")
LOSSES = Registry("policy loss")
DISTILLATION_LOSSES = Registry("distillation loss")
REWARDS = Registry("reward function")
REWARD_MANAGERS = Registry("reward manager")
TOOL_PARSERS = Registry("tool parser")
DISPATCH = Registry("dispatch mode")
DATASETS = Registry("dataset")


@DISPATCH.register("one_to_all")
def one_to_all(df, workers: int):
    """Every task sees the table, which must be small: joins with it broadcast it."""
    from pyspark.sql import functions as F

    return F.broadcast(df)


@DISPATCH.register("dp")
def by_parts(df, workers: int):
    """Equal parts in turn."""
    return df.repartition(workers)


@DISPATCH.register("by_key")
def by_key(df, workers: int, *keys: str):
    """Rows of one key in one part."""
    return df.repartition(workers, *keys)


def load_dataset(path: str, name: str, spark, *paths: str):
    """A dataset made by a function of a Python file from (session, paths); it must be a DataFrame."""
    from pyspark.sql import DataFrame

    out = load_function(path, name)(spark, *paths)
    if not isinstance(out, DataFrame):
        raise TypeError(f"{name} of {path} gives no DataFrame")
    return out


def load_function(path: str, name: str, **bound) -> Callable:
    """``name`` of the Python file at ``path``, with keyword arguments bound."""
    spec = importlib.util.spec_from_file_location("quillstream_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name!r}")
    f = getattr(module, name)
    return (lambda *a, **k: f(*a, **{**bound, **k})) if bound else f
