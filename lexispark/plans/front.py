"""Front doors: one text, a list, or an ensemble of one's own, with a detector that is made once for each session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .config import Config
from .detect import Detector, Result

_default: dict[str, tuple[SparkSession, Detector]] = {}


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lexispark").getOrCreate()


def default_detector(mode: str = "short") -> Detector:
    """The detector of the mode with default settings; a new one only after reset_default() or in another session."""
    spark = _session()
    if mode not in _default or _default[mode][0] is not spark:
        _default[mode] = (spark, Detector(spark, Config(mode=mode)))
    return _default[mode][1]


def reset_default() -> None:
    _default.clear()


def detect(text: str | None, mode: str = "short", **options) -> Result:
    return default_detector(mode).detect(text, **options)


def detect_batch(texts: list[str | None], mode: str = "short", **options) -> list[Result]:
    """Results in the order of the texts."""
    return default_detector(mode).detect_batch(texts, **options)


def ensemble(text: str | None, backends: list[str] | None = None, weights: dict[str, float] | None = None, strategy: str = "weighted", top_k: int = 1, mode: str = "short") -> Result:
    """Detection with the given backends, weights and voting strategy."""
    config = Config(mode=mode, voting=strategy, backend_weights=weights or {}, **({"backends": tuple(backends)} if backends is not None else {}))
    return Detector(_session(), config).detect(text, top_k=top_k)
