"""Name -> (query, oracle SQL, operator ids). The only place that knows the driver contract."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from eventloom.plans import views
from eventloom.session import tune


@dataclass(frozen=True)
class Entry:
    name: str
    ops: tuple[str, ...]
    run: Callable
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(ops: str, sql: str | None = None, use: str = ""):
    """Register ``fn(spark, sf_dir)``. ``use`` names the views the oracle SQL builds on."""

    def wrap(fn):
        def run(spark, sf_dir):
            return fn(tune(spark), str(sf_dir).rstrip("/"))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        text = views.oracle(use, sql) if sql is not None else None
        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        ENTRIES[fn.__name__] = Entry(fn.__name__, tuple(ops.split()), run, text)
        return fn

    return wrap


def load() -> dict[str, Entry]:
    from eventloom.plans import (  # noqa: F401
        event_queries,
        frame_queries,
        pixel_queries,
        series_queries,
        source_queries,
        stats_queries,
        tag_queries,
    )

    return ENTRIES
