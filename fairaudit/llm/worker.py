"""What a Python worker keeps from one task to the next.

Spark hands a worker on from stage to stage and from job to job. What one kind of
work keeps there would stand beside the memory of the next, so only one kind keeps
anything: when another begins, what was kept is dropped, and comes anew if needed.
"""

from __future__ import annotations

from collections.abc import Callable

_DROP: dict[str, Callable[[], None]] = {}


def keep_for(kind: str, drop: Callable[[], None]) -> None:
    """This task does work of this kind; ``drop`` empties what that keeps.

    Called before each use. What another kind keeps is dropped, and free memory of
    Arrow and of the C library goes back to the system.
    """
    others = [k for k in _DROP if k != kind]
    if others:
        import pyarrow as pa
        for k in others:
            _DROP.pop(k)()
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()
    _DROP[kind] = drop
