"""Settings of a run: defaults, overlaid by the session's configuration and then by the environment."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX = "spark.figloom."


@dataclass(frozen=True)
class Settings:
    """What a run may change. ``spark.figloom.<name>`` and ``FIGLOOM_<NAME>`` set a field; the environment goes first."""

    image_dir: str = "images"
    threads: int = 8
    flush: int = 100
    tries: int = 6
    relevance_threshold: float = 7.0
    iqr_slack: float = 1.0
    target_side: int = 1024
    max_pixels: int = 1_048_576
    max_tokens: int = 2048
    on_corrupt: str = "raise"

    @classmethod
    def of(cls, spark: SparkSession | None = None) -> Settings:
        """The settings of a session. A value that does not fit its field is an error that names it."""
        out = {}
        for f in dataclasses.fields(cls):
            text = os.environ.get(f"FIGLOOM_{f.name.upper()}")
            if text is None and spark is not None:
                text = spark.conf.get(PREFIX + f.name, None)
            if text is not None:
                try:
                    out[f.name] = type(f.default)(text)
                except ValueError:
                    raise ValueError(f"{f.name} is no {type(f.default).__name__}: {text}") from None
        return cls(**out)
