"""The analyzers by name; others can be registered or installed under an entry point."""

from __future__ import annotations

from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.analyzers.builtin import BUILTIN
from zbior.analyzers.config import AnalysisConfig

#: Entry point group in which other packages offer analyzers.
GROUP = "zbior.analyzers"
# Other names under which the same analyzers are asked for.
ALIASES = {"token_counter": "token_count", "url_analysis": "url_analyzer"}
_EXTRA: dict[str, type] = {}


class Analyzer(Protocol):
    """``apply`` adds one struct column named ``name`` to a frame with ``content`` and ``content_urls``.

    ``setup`` (before the first frame) and ``close`` (after the plan is made) may be left out.
    """

    name: str

    def apply(self, df: DataFrame) -> DataFrame: ...


def register(cls: type) -> type:
    _EXTRA[cls.name] = cls
    return cls


def _known() -> dict[str, Any]:
    return {**{e.name: e for e in entry_points(group=GROUP)}, **BUILTIN, **_EXTRA}


def list_analyzers() -> list[str]:
    return sorted(_known())


def create(name: str, **params: Any) -> Analyzer:
    """KeyError for a name that nobody offers."""
    cls = _known()[ALIASES.get(name, name)]
    return (cls if isinstance(cls, type) else cls.load())(**params)


def run(df: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``df`` with a column of results for each configured analyzer; all of it is one pass over the rows.

    An analyzer that cannot be made or applied does not stop the others: its column is null, and
    ``analysis_errors`` (a map, there only if there are any) says why. A name that nobody offers raises KeyError. An error
    within rows stops the job as any error of a task does; the built-in analyzers raise none.
    """
    if not config.enabled:
        return df
    errors: dict[str, str] = {}
    for a in config.analyzers:
        if ALIASES.get(a.name, a.name) not in _known():
            raise KeyError(a.name)
        try:
            analyzer = create(a.name, **a.params)
            getattr(analyzer, "setup", lambda: None)()
            try:
                out = analyzer.apply(df)
                out.schema  # the plan is analysed here, so that an error in it is this analyzer's
            finally:
                getattr(analyzer, "close", lambda: None)()
            df = out
        except Exception as e:
            errors[a.name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            df = df.withColumn(ALIASES.get(a.name, a.name), F.lit(None).cast("struct<error:string>"))
    if errors:
        df = df.withColumn("analysis_errors", F.create_map(*[F.lit(x) for pair in errors.items() for x in pair]))
    return df
