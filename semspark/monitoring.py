"""Wall time and driver memory of the parts of a program."""

from __future__ import annotations

import contextlib
import logging
import resource
import time
from collections.abc import Iterator

log = logging.getLogger("semspark")


@contextlib.contextmanager
def timed(what: str, level: int = logging.INFO) -> Iterator[dict[str, float]]:
    """Log how long a block took; the dict it gives holds seconds and peak_mb afterwards."""
    out: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out |= {"seconds": time.perf_counter() - began, "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}
        log.log(level, "%s: %.3f s, %.0f MB at most", what, out["seconds"], out["peak_mb"])
