"""Calls again what failed for a passing reason."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from .errors import TransientError


def retry(call: Callable, attempts: int = 3, base: float = 0.5, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after a TransientError, waiting base * 2**n up to cap, give or take a tenth."""
    for n in range(attempts):
        try:
            return call()
        except TransientError:
            if n == attempts - 1:
                raise
            sleep(min(cap, base * 2**n) * random.uniform(0.9, 1.1))
