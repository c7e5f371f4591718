"""Configuration of a detection plan, and its builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace


class LanguageError(Exception):
    """Base of this library's errors."""


class ConfigurationError(LanguageError):
    pass


class DetectionError(LanguageError):
    pass


class BackendError(LanguageError):
    pass


class VotingError(LanguageError):
    pass


class HintError(LanguageError):
    pass


class ContextError(LanguageError):
    pass


@dataclass(frozen=True)
class Config:
    """Immutable; ``with_*`` methods of Builder return changed copies."""

    mode: str = "default"
    backends: tuple = ("lexicon", "ngram_nb", "ngram_rank", "script")
    backend_weights: dict[str, float] = field(default_factory=dict)
    voting: str | Callable = "weighted"
    allowed: tuple[str, ...] = ()
    filter_proper_nouns: bool = True
    noun_strategy: str = "remove"
    short_circuit: bool = True
    strict_scripts: bool = False
    hint_weight: float = 0.3
    hint_confidence: float = 0.8
    context_weight: float = 0.2
    thresholds: dict[str, float] = field(default_factory=lambda: {"short": 0.3, "default": 0.5, "long": 0.6})
    allow_unknown: bool = True
    unknown_label: str = "und"
    normalize: str = "max"
    resolve_confusion: bool = False
    compose: bool = True
    once_per_text: bool = False

    def __post_init__(self):
        if self.mode not in ("short", "default", "long"):
            raise ConfigurationError(f"unknown mode {self.mode!r}")
        if self.normalize not in ("max", "sum"):
            raise ConfigurationError("normalize is max or sum")


class Builder:
    def __init__(self, config: Config | None = None):
        self._config = config or Config()

    def _with(self, **changes) -> Builder:
        return Builder(replace(self._config, **changes))

    def with_mode(self, mode: str) -> Builder:
        return self._with(mode=mode)

    def with_backends(self, *backends) -> Builder:
        return self._with(backends=tuple(backends))

    def with_weights(self, **weights: float) -> Builder:
        return self._with(backend_weights=weights)

    def with_voting(self, voting: str | Callable) -> Builder:
        return self._with(voting=voting)

    def with_languages(self, *langs: str) -> Builder:
        return self._with(allowed=langs)

    def with_proper_noun_filter(self, on: bool = True, strategy: str = "remove") -> Builder:
        return self._with(filter_proper_nouns=on, noun_strategy=strategy)

    def with_script_short_circuit(self, on: bool = True, strict: bool = False) -> Builder:
        return self._with(short_circuit=on, strict_scripts=strict)

    def with_hint_weight(self, weight: float) -> Builder:
        return self._with(hint_weight=weight)

    def with_context_weight(self, weight: float) -> Builder:
        return self._with(context_weight=weight)

    def with_thresholds(self, **thresholds: float) -> Builder:
        return self._with(thresholds=self._config.thresholds | thresholds)

    def with_unknown_policy(self, allow: bool = True, label: str = "und") -> Builder:
        return self._with(allow_unknown=allow, unknown_label=label)

    def with_normalization(self, how: str) -> Builder:
        return self._with(normalize=how)

    def with_confusion_resolution(self, on: bool = True) -> Builder:
        return self._with(resolve_confusion=on)

    def build(self) -> Config:
        return self._config
