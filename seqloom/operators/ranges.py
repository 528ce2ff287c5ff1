"""One long array in several, as files of a suffix array that no single task makes are."""

from __future__ import annotations

import numpy as np


class Ranges:
    """Arrays of equal length, the last may be shorter, read as one. They may be mapped from files, so only what is asked is read."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts, self.each = parts, len(parts[0])
        self.size = sum(map(len, parts))
        self.firsts = np.array([p[0] for p in parts])
        self.dtype = parts[0].dtype

    def __len__(self) -> int:
        return self.size

    def _each_part(self, k: np.ndarray):
        """Each part that is asked, and the places of those that ask it."""
        order = np.argsort(k, kind="stable")
        cuts = np.flatnonzero(np.diff(k[order], prepend=-1))
        for own in np.split(order, cuts[1:]) if len(k) else ():
            yield int(k[own[0]]), own

    def __getitem__(self, at):
        """The values at one index, or at an array or a slice of them, none negative."""
        if isinstance(at, slice):
            at = np.arange(*at.indices(self.size))
        if np.ndim(at) == 0:
            part, own = divmod(int(at), self.each)
            return self.parts[part][own].item()
        out = np.empty(len(at), self.dtype)
        for part, own in self._each_part(at // self.each):
            out[own] = self.parts[part][at[own] - part * self.each]
        return out

    def searchsorted(self, values: np.ndarray, side: str = "left", sorter: None = None) -> np.ndarray:
        """As of one sorted array. A value's place lies in the last part that begins before it, so one part is searched for each value."""
        out = np.empty(len(values), np.int64)
        k = np.maximum(np.searchsorted(self.firsts, values, side) - 1, 0)
        for part, own in self._each_part(k):
            out[own] = part * self.each + np.searchsorted(self.parts[part], values[own], side)
        return out
