"""The update rule of the difficulty in force, for stretches of a run that do not know what came before.

A value takes over when it differs from the one in force by more than a threshold (the first one always does); a null
leaves the one in force. Whatever a stretch starts with, its path is fixed from the first value that takes over: so the
stretch is told by those of its values that can be the first (``tests``: each lies below or above all before it) and what
is in force at the end for each of them (``exits``). Values between two earlier ones cannot be first: the farther of the
two differs at least as much. Once the tests are three thresholds apart one of them takes over from any start.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

Summary = tuple[list[float], list[float]]


def differs(value: float, in_force: float | None, threshold: float) -> bool:
    return in_force is None or abs(value - in_force) > threshold


def replay(values: Iterable[float | None], start: float | None, threshold: float) -> list[float | None]:
    """The value in force after each of a stretch."""
    in_force, found = start, []
    for value in values:
        if value is not None and differs(value, in_force, threshold):
            in_force = value
        found.append(in_force)
    return found


def _extremes(values: Iterable[float], threshold: float, low: float | None = None, high: float | None = None) -> Iterable[tuple[int, float]]:
    """(place, value) of values below or above all before them, until they are three thresholds apart."""
    for place, value in enumerate(values):
        if low is not None and high - low > 3 * threshold:
            return
        if low is None or value < low or value > high:
            low, high = (value, value) if low is None else (min(low, value), max(high, value))
            yield place, value


def summarize(values: Iterable[float | None], threshold: float) -> Summary:
    """Tests and exits of a stretch."""
    own = [value for value in values if value is not None]
    exit_of: dict[int, float] = {}  # by the place of a value that took over; paths that meet stay together
    tests, exits = [], []
    for place, value in _extremes(own, threshold):
        path, in_force, end = [place], value, None
        for after in range(place + 1, len(own)):
            if abs(own[after] - in_force) > threshold:
                end = exit_of.get(after)
                if end is not None:
                    break
                path.append(after)
                in_force = own[after]
        end = in_force if end is None else end
        exit_of.update(dict.fromkeys(path, end))
        tests.append(value)
        exits.append(end)
    return tests, exits


def carried(summary: Summary, start: float | None, threshold: float) -> float | None:
    """The value in force after a stretch that starts with ``start``."""
    return next((end for test, end in zip(*summary) if differs(test, start, threshold)), start)


def compose(parts: Sequence[Summary], threshold: float) -> Summary:
    """The summary of stretches that follow each other."""
    tests: list[float] = []
    exits: list[float] = []
    for part in parts:
        moved = {end: carried(part, end, threshold) for end in set(exits)}
        exits = [moved[end] for end in exits]
        low, high = (min(tests), max(tests)) if tests else (None, None)
        for place, value in _extremes(part[0], threshold, low, high):
            tests.append(value)
            exits.append(part[1][place])
    return tests, exits


def starts(parts: Sequence[Summary], start: float | None, threshold: float) -> list[float | None]:
    """What each of the stretches that follow each other starts with."""
    found = []
    for part in parts:
        found.append(start)
        start = carried(part, start, threshold)
    return found
