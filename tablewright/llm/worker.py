"""State that Python workers keep between tasks, and word splitting on bytes.

Functions here run on executors and are pickled by value, so executors need not
have the package installed; what should outlive a task lives in a module that
the worker process makes itself.
"""

from __future__ import annotations

import itertools
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ASCII white space; bytes.split() splits on exactly these.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def keep(key, make):
    """``make()`` once per worker process while the same key is asked for.

    Another key takes its place: workers are used again by later queries, and the
    state of several operators side by side would not fit an executor."""
    home = sys.modules.setdefault("_tablewright_llm_worker", types.ModuleType("_tablewright_llm_worker"))
    slot = home.__dict__.setdefault("slot", {})
    if key not in slot:
        slot.clear()
        slot[key] = make()
    return slot[key]


def release():
    """Gives up what an operator before kept; for tasks of operators that keep nothing."""
    sys.modules.get("_tablewright_llm_worker", types.SimpleNamespace(slot={})).__dict__.get("slot", {}).clear()


def each(column, step: int = 256):
    """The values of an Arrow array, ``step`` of them as Python objects at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def slices(column, size: int):
    """An Arrow array of texts in parts of at most about ``size`` bytes."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield column.slice(at, to - at)
        at = to


def gathered(lists: list, codes) -> tuple:
    """(ids, ends): the ids (given as bytes, 4 each) that ``codes`` name, one after the other, and where those of each code end."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(lists), "<u4")))
    return ids.take(pa.array(codes)).flatten().to_numpy(), np.cumsum(sizes[codes])


class Memo(dict):
    """A dict that computes missing values, of at most about ``size`` bytes.

    When half of that is full, its entries step back into an older half; one that is asked for there
    comes forward again, and what stayed there till the next change is forgotten.  So frequent entries last.
    Values of keys longer than ``LONG`` are computed each time."""

    #: Longest key that is kept, and about the bytes that an entry takes.
    LONG, ENTRY = 80, 200

    def __init__(self, compute, size):
        self.compute, self.half, self.older = compute, size // (2 * self.ENTRY), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if key.__class__ is not int and len(key) > self.LONG:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: list, make) -> list:
        """The values of distinct keys; ``make`` computes those that are missing, given as a list, as a dict."""
        values = list(map(self.get, keys))
        gaps = [k for k, v in zip(keys, values) if v is None]
        fill = {k: v for k in gaps if (v := self.older.get(k)) is not None}
        fill |= make([k for k in gaps if k not in fill])
        if len(self) + len(fill) > self.half:
            self.older = dict(self)
            self.clear()
        self.update((k, v) for k, v in itertools.islice(fill.items(), self.half) if len(k) <= self.LONG)
        return [fill[k] if v is None else v for k, v in zip(keys, values)]
