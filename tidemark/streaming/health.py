"""Health of streaming queries: the lifecycle, the first failure, and a generation that rises with every change."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Health:
    lifecycle: str = "idle"
    failure: str | None = None
    generation: int = 0


class HealthWatch(StreamingQueryListener):
    """A coalescing watch on the latest health; the first failure is kept and poisons it.

    Add it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self._state, self._changed = Health(), threading.Condition()

    def _move(self, lifecycle: str, failure: str | None = None) -> None:
        with self._changed:
            now = self._state
            if now.lifecycle != "poisoned":
                self._state = Health(lifecycle, now.failure or failure, now.generation + 1)
                self._changed.notify_all()

    def current(self) -> Health:
        return self._state

    def changed(self, since: int, timeout: float) -> Health:
        """The latest health, once its generation is beyond ``since`` or time is up."""
        with self._changed:
            self._changed.wait_for(lambda: self._state.generation > since, timeout)
            return self._state

    def onQueryStarted(self, event: object) -> None:
        self._move("running")

    def onQueryProgress(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self._move("poisoned" if event.exception else "closed", event.exception)
