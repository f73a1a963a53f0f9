"""Linear-time suffix sorting by grouping."""

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` in rising order.

    ``text`` holds integers from 0 to about its length; a suffix that is a prefix of
    another comes first.

    Groups are processed from the highest down. Suffixes of a group begin with the
    same string; once a group has been processed, that is the longest Lyndon word
    they begin with. The previous smaller suffix of each member is the nearest one to
    its left whose group is lower: its own prefix grows by that of the group, so it
    moves to a higher place within its old group, the further up the more members
    point to it. Nothing is renamed or sorted again: a second pass walks through the
    array from its lowest suffix and puts every suffix that is followed by the
    current one on the next free place of its group.
    """
    n = len(text) + 1
    symbols = np.concatenate([np.asarray(text, np.int64) + 1, [0]])
    order = np.argsort(symbols, kind="stable")
    first = np.searchsorted(symbols[order], symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    suffix: list[int] = order.tolist()  # by place
    place = place.tolist()
    group: list[int] = first.tolist()  # the first place of a suffix's group
    size: list[int] = np.bincount(first, minlength=n).tolist()
    smaller = [-1] * n  # the previous smaller suffix

    end = n
    while end > 1:
        start = group[suffix[end - 1]]
        pointed: dict[int, int] = {}
        members = suffix[start:end]
        if end - start > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            levels = [by_count[k] for k in sorted(by_count, reverse=True)]
        for level in levels:
            touched: dict[int, int] = {}
            for p in level:  # to the end of what is left of its group
                g = group[p]
                left = size[g] - 1
                size[g] = left
                last, here = g + left, place[p]
                if last != here:
                    q = suffix[last]
                    suffix[last], suffix[here] = p, q
                    place[p], place[q] = last, here
                touched[g] = last
            for p in level:
                group[p] = touched[group[p]]
            for new in touched.values():  # a group of which all moved keeps its place
                size[new] = 0
            for p in level:
                size[group[p]] += 1

    result = [-1] * n
    free = list(range(n))  # by the first place of a group: its next free place
    done = bytearray(n)
    result[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        s = result[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            result[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return np.array(result[1:], np.int64)
