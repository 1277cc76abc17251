"""Line diffs: the shortest edit script between two texts, as a unified patch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import HELD

#: Unchanged lines around a change.
CONTEXT = 3
# Fixed value: what a patch says of a last line without a line feed.
NO_NEWLINE = "\\ No newline at end of file"


def lines_of(text: str) -> list[str]:
    """The lines of a text with their line feeds."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (x, y) to (u, v) in the middle of a shortest
    script: searches from both ends take one more edit at a time until they meet."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    top = (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(top + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not odd and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("the searches meet")


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common run of lines, in order.  Space grows
    with the lines, time with them and the edits between them."""
    out, left = [], [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        if a0 == "done":
            out.append((a1, b0))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        ends = 0
        while a0 < a1 - ends and b0 < b1 - ends and a[a1 - 1 - ends] == b[b1 - 1 - ends]:
            ends += 1
        after = [("done", a1 - i, b1 - i, None) for i in range(1, ends + 1)]
        a1, b1 = a1 - ends, b1 - ends
        left += after
        if a0 < a1 and b0 < b1:
            x, y, u, v = middle(a[a0:a1], b[b0:b1])
            left.append((a0 + u, a1, b0 + v, b1))
            left += [("done", a0 + x + i, b0 + y + i, None) for i in reversed(range(u - x))]
            left.append((a0, a0 + x, b0, b0 + y))
    return out


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines of a shortest edit script.  Lines that only one
    side has are edits for certain and are left out before the search."""
    both = set(old) & set(new)
    numbers = {line: i for i, line in enumerate(both)}
    a = [i for i, line in enumerate(old) if line in both]
    b = [i for i, line in enumerate(new) if line in both]
    found = matches([numbers[old[i]] for i in a], [numbers[new[i]] for i in b])
    return [(a[x], b[y]) for x, y in found]


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(a0, a1, b0, b1): old[a0:a1] becomes new[b0:b1], in order, nothing equal between."""
    out, a, b = [], 0, 0
    for x, y in [*common_lines(old, new), (len(old), len(new))]:
        if x > a or y > b:
            out.append((a, x, b, y))
        a, b = x + 1, y + 1
    return out


def span(start: int, stop: int) -> str:
    """Lines in a hunk's head: the first and, but for one, their number."""
    n = stop - start
    return f"{start + 1}" if n == 1 else f"{start + 1 if n else start},{n}"


def unified(old: str, new: str, name: str, context: int = CONTEXT) -> str:
    """The patch from ``old`` to ``new``; empty if they are equal."""
    if old == new:
        return ""
    a, b = lines_of(old), lines_of(new)
    hunks: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if hunks and c[0] - hunks[-1][-1][1] <= 2 * context:
            hunks[-1].append(c)
        else:
            hunks.append([c])
    out = [f"--- a/{name}\n", f"+++ b/{name}\n"]

    def put(mark: str, lines: list[str]) -> None:
        out.extend(mark + line if line.endswith("\n") else f"{mark}{line}\n{NO_NEWLINE}\n" for line in lines)

    for hunk in hunks:
        before = min(context, hunk[0][0])
        after = min(context, len(a) - hunk[-1][1])
        a0, a1, b0, b1 = hunk[0][0] - before, hunk[-1][1] + after, hunk[0][2] - before, hunk[-1][3] + after
        out.append(f"@@ -{span(a0, a1)} +{span(b0, b1)} @@\n")
        at = a0
        for x, y, u, v in hunk:
            put(" ", a[at:x])
            put("-", a[x:y])
            put("+", b[u:v])
            at = y
        put(" ", a[at:a1])
    return "".join(out)


def patched(old: str, patch: str) -> str:
    """``old`` after a patch; a patch that does not fit is an error."""
    if not patch:
        return old
    a, out, at, last = lines_of(old), [], 0, ""
    for line in lines_of(patch)[2:]:
        mark, rest = line[0], line[1:]
        if mark == "@":
            start, _, n = line.split()[1][1:].partition(",")
            begin = int(start) - (n != "0")
            out += a[at:begin]
            at = begin
        elif mark == "\\":
            if last in " +":
                out[-1] = out[-1].removesuffix("\n")
            if last in " -" and a[at - 1].endswith("\n"):
                raise ValueError("the patch does not fit")
        else:
            if mark in " -":
                if a[at].removesuffix("\n") != rest.removesuffix("\n"):
                    raise ValueError("the patch does not fit")
                at += 1
            if mark in " +":
                out.append(rest)
        last = mark
    return "".join(out + a[at:])


def each(f: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """``f`` of each row, of which few are Python objects at once."""
    made = [pa.array(list(map(f, *(c.slice(at, HELD).to_pylist() for c in columns))), pa.string()) for at in range(0, len(columns[0]), HELD)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def diff(old: Column, new: Column, name: Column) -> Column:
    """The unified patch from ``old`` to ``new`` under a file's ``name``; empty
    where they are equal, null where one is null."""

    @F.arrow_udf("string")
    def run(old: pa.Array, new: pa.Array, name: pa.Array) -> pa.Array:
        return each(lambda o, n, p: None if o is None or n is None else unified(o, n, p or ""), old, new, name)

    return run(old, new, name.cast("string"))


def apply(old: Column, patch: Column) -> Column:
    """``old`` after the ``patch``; null where one is null."""

    @F.arrow_udf("string")
    def run(old: pa.Array, patch: pa.Array) -> pa.Array:
        return each(lambda o, p: None if o is None or p is None else patched(o, p), old, patch)

    return run(old, patch)


def count(patch: Column, mark: str) -> Column:
    """How many lines of a patch begin with ``mark`` (+, - or @@), its head left out."""
    body = F.regexp_replace(patch, r"\A--- [^\n]*\n\+\+\+ [^\n]*\n", "")
    return F.when(patch.isNotNull(), F.size(F.filter(F.split(body, "\n"), lambda x: x.startswith(mark)))).cast("long")
