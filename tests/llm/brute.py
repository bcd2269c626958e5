"""Plain versions that several tests compare with."""

import sys

from quadloom.llm import linedup

sys.setrecursionlimit(20_000)


def plain_patience(a, b):
    """Patience diff by the book, recursively, with quadratic longest rising runs."""

    def rising(pairs):
        best = []
        for i, (_, y) in enumerate(pairs):
            before = max((best[k] for k in range(i) if pairs[k][1] < y), key=len, default=[])
            best.append([*before, pairs[i]])
        return max(best, key=len, default=[])

    def between(a0, a1, b0, b1):
        if a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            return [(a0, b0), *between(a0 + 1, a1, b0 + 1, b1)]
        if a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            return [*between(a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
        x, y = a[a0:a1], b[b0:b1]
        anchors = rising([(a0 + i, b0 + y.index(line)) for i, line in enumerate(x) if x.count(line) == 1 and y.count(line) == 1])
        if not anchors:
            number = lambda lines: [(line, lines[:i].count(line)) for i, line in enumerate(lines)]
            return rising([(a0 + i, b0 + number(y).index(one)) for i, one in enumerate(number(x)) if one in number(y)])
        out = []
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            out += [*between(i + 1, p, j + 1, q), *([(p, q)] if p < a1 else [])]
        return out

    return between(0, len(a), 0, len(b))


def removed_by_all_pairs(rows):
    """Line numbers that each document loses if every two documents that share a long line are aligned."""
    split = {d: [x.encode().strip().decode() for x in t.split("\n")] for d, t in rows.items()}
    long = {d: {x for x in lines if len(x) >= linedup.MIN_CHARS} for d, lines in split.items()}
    holders, gone = {}, {d: set() for d in rows}
    for d in sorted(rows):
        for other in sorted({o for x in long[d] for o in holders.get(x, ())}):
            a, b, common = split[other], split[d], long[d] & long[other]
            at_a, at_b = [i for i, x in enumerate(a) if x in common], [j for j, x in enumerate(b) if x in common]
            pairs = [(at_a[i], at_b[j]) for i, j in plain_patience([a[i] for i in at_a], [b[j] for j in at_b])]
            for k, (i, j) in enumerate(pairs):
                # The block around an aligned line: equal lines after it, then before it, up to the next aligned ones.
                stop = pairs[k + 1] if k + 1 < len(pairs) else (len(a), len(b))
                back = pairs[k - 1] if k else (-1, -1)
                gone[d].add(j)
                n = 1
                while i + n < stop[0] and j + n < stop[1] and a[i + n] == b[j + n]:
                    gone[d].add(j + n)
                    n += 1
                n = 1
                while i - n > back[0] and j - n > back[1] and a[i - n] == b[j - n]:
                    gone[d].add(j - n)
                    n += 1
        for x in long[d]:
            holders.setdefault(x, []).append(d)
    return gone
