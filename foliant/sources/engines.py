"""Recognisers as a plug-in: anything that turns a path and its text into lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

LINES = "source string, line_no int, text string, x double, y double, w double, h double, confidence double"
Recognise = Callable[[str, str | None], list[tuple]]

ENGINES: dict[str, Callable[[], Recognise]] = {}


def engine(name: str):
    """Register a factory; it is called once a Python worker, so models load there."""
    def put(factory):
        ENGINES[name] = factory
        return factory

    return put


@engine("text")
def _text() -> Recognise:
    """Lines of a text, with geometry by position."""
    def run(source: str, text: str | None):
        return [(source, i, s, 0.0, 28.0 * i, max(50.0, 9.0 * len(s)), 22.0, 1.0) for i, s in enumerate((text or "").split("\n")) if s.strip()]

    return run


def recognise(df: DataFrame, source: str, text: str, names: tuple[str, ...] = ("text",)) -> DataFrame:
    """Lines by the first engine that gives any; an engine that raises is passed over."""
    factories = [ENGINES[n] for n in names]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [f() for f in factories]
        for pdf in it:
            out: list[tuple] = []
            for s, t in zip(pdf["s"], pdf["t"], strict=True):
                for r in made:
                    try:
                        got = r(s, t)
                    except Exception:  # noqa: BLE001 - the next engine is the fallback
                        continue
                    if got:
                        out += got
                        break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return df.selectExpr(f"cast({source} as string) as s", f"{text} as t").mapInPandas(run, LINES)
