"""Worker-side tables of words already seen. A worker serves many stages: only one operator's table lives at a time."""

from __future__ import annotations

import ctypes

_tables: dict[str, dict] = {}


def table(name: str, kind: type[dict] = dict) -> dict:
    """The named table of this worker process; those of other names are emptied."""
    if name not in _tables:
        _tables[name] = kind()
    others = [t for other, t in _tables.items() if other != name and t]
    for t in others:
        t.clear()
    if others:
        _give_back()
    return _tables[name]


def _give_back() -> None:
    """Return what was freed to the system: both allocators keep it otherwise, beside what the next stage takes."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
