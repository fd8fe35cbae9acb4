"""Text configuration, read on the driver: lists, numbers with relative times, and files that are watched for change."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from .policies import seconds


def lines(text: str) -> list[str]:
    """Trimmed lines; blank ones and those that begin with ``#`` are left out."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def find_file(name: str, folder: str | None = None) -> str | None:
    """An absolute path, or a file of the application's folder or of the working folder."""
    for place in [name] if os.path.isabs(name) else [os.path.join(folder, name)] * bool(folder) + [name]:
        if os.path.exists(place):
            return place
    return None


def any_match(name: Column, patterns: Iterable[str]) -> Column:
    """True where any of the patterns is found in the name; ``.*`` and ``*`` always are."""
    patterns = list(patterns)
    if any(p in (".*", "*") for p in patterns):
        return F.lit(True)
    # One alternation keeps the expression small; groups stay as they are because nothing refers to them.
    return F.coalesce(name.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def merge_rules(generic: str, by_id: dict[str, str], own_id: str | None = None, template: str | None = None) -> str:
    """Rules in the order in which they hold: the template's, those of the id, the generic ones."""
    parts = [template or "", by_id.get(own_id or "", ""), generic]
    return "\n".join(p for p in parts if p)


def relative_from(value: int | str, now: int) -> int:
    """Absolute if 0 or more, else before now. Texts such as ``-30d`` are before now."""
    if isinstance(value, str) and re.fullmatch(r"-\d+[smhdy]", value):
        return now - seconds(value[1:])
    return int(value) if int(value) >= 0 else now + int(value)


def relative_to(value: int | str, now: int) -> int:
    """Like ``relative_from``, but 0 is now."""
    return now if not isinstance(value, str) and value == 0 else relative_from(value, now)


class Watched:
    """The parsed content of a file, read again when it has changed and ``period`` has passed; a bad file keeps the old content."""

    def __init__(self, path: str, parse: Callable[[str], object], period: float = 30, clock: Callable[[], float] = time.monotonic) -> None:
        self.path, self.parse, self.period, self.clock = path, parse, period, clock
        self.revision, self.value, self._stamp, self._checked = 0, None, None, None
        self.get()

    def get(self):
        now = self.clock()
        if self._checked is None or now - self._checked >= self.period:
            self._checked = now
            try:
                stamp = os.stat(self.path).st_mtime_ns, os.stat(self.path).st_size
                if stamp != self._stamp:
                    with open(self.path, encoding="utf-8") as f:
                        self.value = self.parse(f.read())
                    self.revision, self._stamp = self.revision + 1, stamp
            except (OSError, ValueError):
                pass
        return self.value


def changes(old: Iterable[str], new: Iterable[str]) -> tuple[set[str], set[str]]:
    """(added, removed), for streams and destinations that follow a list."""
    old, new = set(old), set(new)
    return new - old, old - new
