"""What a worker remembers: memos of fixed size, one operator's at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

KEPT: dict[str, object] = {}


class Memo(dict):
    """A dict that makes what it lacks and forgets old entries: what was not asked for while `most` others came goes."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Hashable):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def kept(name: str, make: Callable):
    """make()'s result, kept for later tasks of this worker under `name`."""
    if name not in KEPT:
        release()
        KEPT[name] = make()
    return KEPT[name]


def release() -> None:
    """Gives back the memory of what other operators' tasks kept in this worker."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)
