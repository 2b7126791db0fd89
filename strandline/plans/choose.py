"""Choices that a driver makes before any data moves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import TypeVar

T = TypeVar("T")


def first_working(options: Iterable[T], attempt: Callable[[T], object]) -> tuple[T, list[tuple[T, str]]]:
    """The first option whose attempt raises nothing, and what went wrong with those before it."""
    failed: list[tuple[T, str]] = []
    for option in options:
        try:
            attempt(option)
        except Exception as e:  # whatever is wrong with it, the next one may do
            failed.append((option, f"{type(e).__name__}: {e}".splitlines()[0]))
        else:
            return option, failed
    raise RuntimeError("nothing works: " + "; ".join(f"{o}: {why}" for o, why in failed))


def by_will(known: Mapping[str, Callable[[], bool]], named: str | None = None, recorded: str | None = None) -> str:
    """The producer that is named, else the recorded one if it is known, else the first that says it is available."""
    plain = lambda x: (x or "").lstrip("﻿").strip().lower()
    if plain(named):
        if plain(named) in known:
            return plain(named)
        raise ValueError(f"unknown: {named}; known are {', '.join(sorted(known))}")
    if plain(recorded) in known:
        return plain(recorded)
    for name, available in known.items():
        if available():
            return name
    raise ValueError("none is named, recorded or available")
