"""Which extractor and reviewer a run uses: rules and templates, or a model."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .extract import Extractor, ModelExtractor, RuleExtractor
from .review import ModelReviewer, Reviewer, TemplateReviewer

OFFLINE = "mock"


@dataclass(frozen=True)
class Provider:
    """A model behind `call(prompt) -> text`; it is available where its key variable is set."""

    name: str
    key_variable: str
    call: Callable[[str], str]


def pick(mode: str, providers: Sequence[Provider] = (), env: Mapping[str, str] | None = None) -> str:
    """The mode if it isn't `auto`; else the first provider with a key; else offline."""
    if mode != "auto":
        return mode
    env = os.environ if env is None else env
    return next((p.name for p in providers if env.get(p.key_variable)), OFFLINE)


def _named(name: str, providers: Sequence[Provider]) -> Provider | None:
    if name == OFFLINE:
        return None
    found = next((p for p in providers if p.name == name), None)
    if found is None:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(p.name for p in providers)}")
    return found


def extractor_for(mode: str, fields: DataFrame, render: Callable[[str, str, str], str], providers: Sequence[Provider] = ()) -> Extractor:
    p = _named(pick(mode, providers), providers)
    return RuleExtractor() if p is None else ModelExtractor(p.call, render, fields)


def reviewer_for(mode: str, providers: Sequence[Provider] = ()) -> Reviewer:
    p = _named(pick(mode, providers), providers)
    return TemplateReviewer() if p is None else ModelReviewer(p.call)
