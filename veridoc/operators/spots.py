"""Merging of boxes at one spot: an ordered sweep whose merged boxes grow and then catch more.

Rows are offered in order to the targets found so far; the first target at the same spot takes the row and widens, and a row
that none takes is a target itself. Afterwards the targets are offered to each other in the same way until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Places in a target or row: id, four sides of the tight box, four of the field box, the only document or None for several.
ID, LEFT, BOTTOM, RIGHT, TOP, F_LEFT, F_BOTTOM, F_RIGHT, F_TOP, DOC = range(10)
LEVEL, OVERLAP, COLUMN = 15.0, 2.0, 28.0


def _start(b: list) -> float:
    return b[F_LEFT] if b[F_RIGHT] > b[F_LEFT] else b[LEFT]


def fits(target: list, row: list) -> bool:
    """Same height and column, and not both from one and the same document."""
    if target[DOC] is not None and target[DOC] == row[DOC]:
        return False
    if abs((target[BOTTOM] + target[TOP]) - (row[BOTTOM] + row[TOP])) * 0.5 > LEVEL:
        return False
    if min(target[TOP], row[TOP]) + OVERLAP < max(target[BOTTOM], row[BOTTOM]):
        return False
    return abs(_start(target) - _start(row)) <= COLUMN or min(target[RIGHT], row[RIGHT]) > max(target[LEFT], row[LEFT])


def widen(target: list, row: list) -> bool:
    """Take in a row; tells whether the target changed."""
    before = target[1:]
    if row[F_RIGHT] > row[F_LEFT]:
        wide, high = target[F_RIGHT] > target[F_LEFT], target[F_TOP] > target[F_BOTTOM]
        target[F_LEFT] = min(target[F_LEFT], row[F_LEFT]) if wide else row[F_LEFT]
        target[F_BOTTOM] = min(target[F_BOTTOM], row[F_BOTTOM]) if high else row[F_BOTTOM]
        target[F_RIGHT], target[F_TOP] = max(target[F_RIGHT], row[F_RIGHT]), max(target[F_TOP], row[F_TOP])
    target[LEFT], target[BOTTOM] = min(target[LEFT], row[LEFT]), min(target[BOTTOM], row[BOTTOM])
    target[RIGHT], target[TOP] = max(target[RIGHT], row[RIGHT]), max(target[TOP], row[TOP])
    if target[DOC] != row[DOC]:
        target[DOC] = None
    return target[1:] != before


def sweep(targets: list[list], rows: Iterable[list]) -> list[str]:
    """Offer rows in order to `targets`, which grow in number and size; the id of the target of each row."""
    out, known, version = [], {}, 0
    for row in rows:
        look = tuple(row[1:])
        seen = known.get(look)
        if seen is not None and seen[0] == version:  # nothing has changed since an equal row
            out.append(seen[1])
            continue
        for t in targets:
            if fits(t, row):
                version += widen(t, row)
                break
        else:
            t = list(row)
            targets.append(t)
            version += 1
        out.append(t[ID])
        # A row of a single document may not fit the target that it has become itself.
        if fits(t, row):
            known[look] = version, t[ID]
    return out


def settle(targets: list[list]) -> dict[str, str]:
    """Offer targets to each other until none is taken: id -> id of the target it ends in."""
    end = {t[ID]: t[ID] for t in targets}
    while True:
        left: list[list] = []
        took = dict(zip((t[ID] for t in targets), sweep(left, targets)))
        end = {k: took[v] for k, v in end.items()}
        if len(left) == len(targets):
            return end
        targets = left
