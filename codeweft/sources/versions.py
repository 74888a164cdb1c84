"""Sets of tables that change together: numbered versions, each committed by one mark.

A set is written to a folder of its own, read back and checked, and counts from the moment that the file
``marks/<number>`` is made, which names the folder.  A file system makes a file for one of several writers only, so of
those that start from one version the first wins and the others get a ``Conflict``.  Readers see the version with the
greatest complete mark, all of its tables or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from codeweft.scratch import create_new, delete, listed, read_small

#: A check of tables that are about to be published; what it returns is what is wrong, or nothing.
Check = Callable[[dict[str, DataFrame]], str | None]


class Conflict(RuntimeError):
    """Another writer has published this version first."""


class Unfit(RuntimeError):
    """The tables didn't pass their check."""


class Versions:
    """The versions in a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def marks(self) -> dict[int, str]:
        """The committed versions' folders by number; marks that were begun and not finished don't count."""
        found = {int(name): read_small(self.spark, f"{self.root}/marks/{name}") for name in listed(self.spark, f"{self.root}/marks") if name.isdigit()}
        return {number: text[:-1] for number, text in sorted(found.items()) if text.endswith("\n")}

    def current(self) -> int:
        """The number of the newest version, 0 if there is none."""
        return max(self.marks(), default=0)

    def tables(self, number: int) -> list[str]:
        """The names of a version's tables."""
        return listed(self.spark, f"{self.root}/{self.marks()[number]}")

    def read(self, *names: str, number: int | None = None) -> list[DataFrame]:
        """Tables of one version, the newest unless another is asked for."""
        marks = self.marks()
        number = max(marks, default=0) if number is None else number
        if number not in marks:
            raise LookupError(f"no version {number} in {self.root}")
        return [self.spark.read.parquet(f"{self.root}/{marks[number]}/{name}") for name in names]

    def publish(self, frames: dict[str, DataFrame], *, after: int | None = None, check: Check | None = None) -> int:
        """Makes ``frames`` the next version and gives its number.

        ``after`` is the version that they were derived from, the newest unless given.  If a write fails, the check
        finds something, or another writer was first, what was written is deleted and readers keep what they had.
        """
        after = self.current() if after is None else after
        folder = f"set-{uuid.uuid4().hex}"
        try:
            for name, df in frames.items():
                df.write.parquet(f"{self.root}/{folder}/{name}")
            if check is not None:
                wrong = check({name: self.spark.read.parquet(f"{self.root}/{folder}/{name}") for name in frames})
                if wrong:
                    raise Unfit(wrong)
            if not create_new(self.spark, f"{self.root}/marks/{after + 1}", f"{folder}\n"):
                raise Conflict(f"version {after + 1} is taken")
        except BaseException:
            delete(self.spark, f"{self.root}/{folder}")
            raise
        return after + 1

    def change(self, names: tuple[str, ...], edit: Callable[..., dict[str, DataFrame]], *, check: Check | None = None, attempts: int = 5) -> int:
        """Publishes what ``edit`` makes of the newest tables; if another writer comes first it is made anew from theirs."""
        for left in reversed(range(attempts)):
            number = self.current()
            try:
                return self.publish(edit(*self.read(*names, number=number)), after=number, check=check)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def recover(self) -> list[str]:
        """Clears what crashed writers left, and names it; to be called while none is at work.

        There are three cases: a set without a mark goes; a mark without its name goes, and the version before is the
        newest again; so it is for a mark whose set is gone or lacks a table's end.
        """
        done: list[str] = []
        for name in listed(self.spark, f"{self.root}/marks"):
            text = read_small(self.spark, f"{self.root}/marks/{name}")
            tables = listed(self.spark, f"{self.root}/{text[:-1]}") if text.endswith("\n") else []
            whole = tables and all("_SUCCESS" in listed(self.spark, f"{self.root}/{text[:-1]}/{t}") for t in tables)
            if not whole:
                done.append(f"marks/{name}")
        for path in done:
            delete(self.spark, f"{self.root}/{path}")
        known = set(self.marks().values())
        lost = [name for name in listed(self.spark, self.root) if name.startswith("set-") and name not in known]
        for name in lost:
            delete(self.spark, f"{self.root}/{name}")
        return done + lost

    def retain(self, keep: int = 3) -> list[int]:
        """Deletes all but the newest ``keep`` versions before the current one, and gives their numbers."""
        marks = self.marks()
        old = sorted(marks)[: max(0, len(marks) - 1 - keep)]
        for number in old:
            delete(self.spark, f"{self.root}/marks/{number}")
            delete(self.spark, f"{self.root}/{marks[number]}")
        return old


def publish_checked(versions: Versions, frames: dict[str, DataFrame], fit: Callable[[dict[str, DataFrame]], DataFrame], **options: Any) -> int:
    """``publish`` with a check that gives one row with a column ``ok``; the row is the error if that is false."""

    def check(read: dict[str, DataFrame]) -> str | None:
        row = fit(read).first()
        return None if row["ok"] else str(row.asDict())

    return versions.publish(frames, check=check, **options)
