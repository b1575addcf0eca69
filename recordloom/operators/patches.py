"""Unified diffs applied to texts held in columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*\n?", re.M)


@dataclass
class Hunk:
    """at: place of its first old line, from 0; old and new: the lines that it takes away and those that come for them."""

    at: int
    old: list[str]
    new: list[str]


def hunks(patch: str) -> list[Hunk]:
    """The hunks of a unified diff in their order; ValueError where a body hasn't the lines that its head counts."""
    out = []
    for head in _HEAD.finditer(patch):
        start, n_old, n_new = int(head[1]), int(head[2] or 1), int(head[4] or 1)
        old: list[str] = []
        new: list[str] = []
        for line in patch[head.end() :].splitlines(keepends=True):
            if line.startswith("\\"):  # the line before has no end in the text
                for side in (old, new):
                    if side and last in " +-" and (last == " " or (last == "-") == (side is old)):
                        side[-1] = side[-1].removesuffix("\n")
                continue
            if len(old) >= n_old and len(new) >= n_new:
                break
            last = line[0] if line[0] in " +-" else " " if line == "\n" else ""
            if not last:
                break
            text = line if line == "\n" else line[1:]
            old += [text] if last in " -" else []
            new += [text] if last in " +" else []
        if (len(old), len(new)) != (n_old, n_new):
            raise ValueError(f"hunk {len(out) + 1} has {len(old)} old and {len(new)} new lines, its head says {n_old} and {n_new}")
        # A hunk without old lines stands behind the line that it names.
        out.append(Hunk(start - 1 if n_old else start, old, new))
    if not out:
        raise ValueError("the patch has no hunk")
    return out


def patched(source: bytes, patch: bytes) -> bytes:
    """source with the hunks of patch; ValueError if one has other counts, overlaps the one before or doesn't fit the text."""
    lines = source.decode().splitlines(keepends=True)
    end, out = 0, []
    for k, hunk in enumerate(hunks(patch.decode()), 1):
        if hunk.at < end:
            raise ValueError(f"hunk {k} begins before the end of the one before")
        if lines[hunk.at : hunk.at + len(hunk.old)] != hunk.old or hunk.at > len(lines):
            raise ValueError(f"hunk {k} doesn't fit the text at line {hunk.at + 1}")
        out += lines[end : hunk.at] + hunk.new
        end = hunk.at + len(hunk.old)
    return "".join(out + lines[end:]).encode()


def apply_patch(source: str, patch: str) -> Column:
    """content, or the error for which there is none; null for a null source or patch."""

    @F.pandas_udf("struct<content: binary, error: string>")
    def apply(source: pd.Series, patch: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(source, patch, strict=True):
            try:
                out.append((patched(bytes(a), bytes(b)), None) if a is not None and b is not None else (None, None))
            except ValueError as error:
                out.append((None, str(error)))
        return pd.DataFrame(out, columns=["content", "error"])

    return apply(source, patch)
