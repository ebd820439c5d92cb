"""Given past events, when an action runs, then these events follow: a check of decision code without Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any


class SpecFailure(AssertionError):
    pass


class Spec:
    """``fold`` makes a state of events; an action takes the state and returns new events."""

    def __init__(self, fold: Callable[[Sequence[Any]], Any]):
        self.fold, self.past, self.made, self.raised = fold, [], None, None

    def given(self, *events: Any) -> Spec:
        self.past = list(events)
        return self

    def when(self, action: Callable[[Any], Sequence[Any] | None]) -> Spec:
        try:
            self.made = list(action(self.fold(self.past)) or ())
        except Exception as e:
            self.raised = e
        return self

    def then(self, *events: Any) -> None:
        if self.raised is not None:
            raise SpecFailure(f"raised {type(self.raised).__name__}") from self.raised
        if len(self.made) != len(events):
            raise SpecFailure(f"{len(events)} events expected, {len(self.made)} made")
        for k, (a, b) in enumerate(zip(self.made, events)):
            if a != b:
                raise SpecFailure(f"event {k} is {a!r}, not {b!r}")

    def then_nothing(self) -> None:
        self.then()

    def then_raises(self, kind: type[Exception]) -> None:
        if not isinstance(self.raised, kind):
            raise SpecFailure(f"{kind.__name__} expected, got {type(self.raised).__name__ if self.raised else 'events'}")
