"""The shortest edit between two texts, line by line."""

#: Deleted and inserted lines up to which the shortest edit is looked for. Work and memory
#: grow with its square, so beyond it the differing middle is one hunk.
MAX_EDITS = 1000


def _snakes(a: list, b: list, max_edits: int):
    """The furthest points of Myers' greedy search, a dict per number of edits; None if
    more than ``max_edits`` are needed."""
    reach, rounds = {1: 0}, []
    for edits in range(min(max_edits, len(a) + len(b)) + 1):
        rounds.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            y = x - k
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= len(a) and y >= len(b):
                return rounds
    return None


def hunks(old: str, new: str, max_edits: int = MAX_EDITS) -> tuple[list, bool]:
    """``(line, n removed, added lines)`` in order, and whether no shorter edit exists.

    Lines are what lies between line feeds, so joined by line feeds they are the text.
    Each hunk replaces ``n removed`` lines of ``old`` from ``line`` on, counted from 0.
    """
    a, b = old.split("\n"), new.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a and not b:
        return [], True
    rounds = _snakes(a, b, max_edits) if a and b else None
    if rounds is None:
        return [(head, len(a), b)], not (a and b)
    # Back from the end, one edit a round.
    x, y, steps = len(a), len(b), []
    for edits in range(len(rounds) - 1, 0, -1):
        reach, k = rounds[edits], x - y
        down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
        before = k + 1 if down else k - 1
        x = reach[before]
        y = x - before
        steps.append((x, y, down))
    out: list[list] = []
    for x, y, down in reversed(steps):
        last = out[-1] if out else None
        if last is None or last[0] + last[1] != x or last[3] != y:
            last = [x, 0, [], y]
            out.append(last)
        if down:
            last[2].append(b[y])
            last[3] += 1
        else:
            last[1] += 1
    return [(head + at, removed, added) for at, removed, added, _ in out], True


def applied(old: str, changes) -> str:
    """``old`` with hunks applied."""
    lines, out, at = old.split("\n"), [], 0
    for line, removed, added in changes:
        out += [*lines[at:line], *added]
        at = line + removed
    return "\n".join(out + lines[at:])
