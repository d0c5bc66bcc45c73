"""All registered queries (name -> callable(spark, sf_dir) -> DataFrame)."""

from __future__ import annotations

from ..session import ensure_checkpoint_dir
from ..streaming import catalog as stream_catalog
from . import catalog, modeling_catalog


def _with_checkpoint(fn):
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    out = dict(catalog.registry())
    out.update(modeling_catalog.registry())
    out.update(stream_catalog.registry())
    return {k: _with_checkpoint(v) for k, v in out.items()}
