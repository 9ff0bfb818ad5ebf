"""Read the physical plan Spark chose, for tests and the bench."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_nodes(df: DataFrame) -> list[str]:
    """Operator names of the physical plan, e.g. ``BroadcastHashJoin``."""
    text = physical_plan(df, "simple")
    return re.findall(r"(?:^|[-+:\s])\*?\(?\d*\)?\s*([A-Z][A-Za-z]+)", text, flags=re.M)
