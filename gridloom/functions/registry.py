"""The registry: function names, their builders and how their arguments are taken."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

SCALAR, AGGREGATE, LAZY, LOOKUP, INFO = "scalar", "aggregate", "lazy", "lookup", "information"


@dataclass(frozen=True)
class Function:
    name: str
    family: str
    mode: str
    build: Callable
    signature: str = ""


REGISTRY: dict[str, Function] = {}


def function(names: str, family: str, mode: str = SCALAR, signature: str = "") -> Callable:
    """Registers a builder under one or more names, separated by blanks."""

    def put(build: Callable) -> Callable:
        for name in names.split():
            REGISTRY[name] = Function(name, family, mode, build, signature)
        return build

    return put


def load() -> dict[str, Function]:
    """All functions; importing the families fills the registry."""
    from . import aggregates, dates, financial, information, logical, maths, texts  # noqa: F401

    return REGISTRY


def catalogue(spark):
    """The functions as a DataFrame: name, family, mode, signature."""
    return spark.createDataFrame(sorted((f.name, f.family, f.mode, f.signature) for f in load().values()), "name string, family string, mode string, signature string")
