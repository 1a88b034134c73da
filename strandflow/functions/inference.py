"""Plug-in boundary for models: a named callable from a batch of texts to scores or vectors, loaded once a worker."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}


def load(name: str) -> object:
    """The object that `module:attribute` names."""
    if name not in _loaded:
        module, _, attribute = name.partition(":")
        if not module or not attribute:
            raise ValueError("a plug-in is named module:attribute")
        _loaded[name] = getattr(importlib.import_module(module), attribute)
    return _loaded[name]


def apply(df: DataFrame, plugin: str, text: str, out: str = "value", kind: str = "array<float>") -> DataFrame:
    """df with the plug-in's result for each text. The plug-in takes a list of texts and returns as many results."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(plugin)
        for s in batches:
            got = list(model(s.tolist()))
            if len(got) != len(s):
                raise ValueError(f"{plugin} returned {len(got)} results for {len(s)} texts")
            yield pd.Series(got, index=s.index)

    return df.withColumn(out, run(F.col(text)))


def composition(texts: list[str]) -> list[list[float]]:
    """A stand-in model: the shares of A, C, G and T of each text."""
    return [[t.count(b) / max(len(t), 1) for b in "ACGT"] for t in texts]
