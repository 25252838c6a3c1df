"""What is going on and how long it took, as log lines."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("lexichron")


@contextmanager
def timed(what: str, times: dict[str, float] | None = None) -> Iterator[None]:
    """Logs the beginning and the elapsed seconds of what runs inside, failed or not, and adds the seconds to `times`."""
    log.info("%s begins", what)
    start = time.perf_counter()
    try:
        yield
    finally:
        seconds = time.perf_counter() - start
        log.info("%s took %.2f s", what, seconds)
        if times is not None:
            times[what] = times.get(what, 0.0) + seconds


def empty(what: str) -> None:
    """A warning that there was nothing to work on."""
    log.warning("no data for %s", what)
