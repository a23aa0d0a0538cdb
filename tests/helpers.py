"""Plain-Python definitions the column expressions are compared with."""


def lcs(a: str, b: str) -> int:
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
        above = row
    return above[-1]


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0

    def best(s: str, t: str) -> float:
        ends = range(1, len(s) + len(t))
        return max(indel(s, t[max(0, e - len(s)) : min(e, len(t))]) for e in ends)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(*sorted((a, b), key=len))


def rows(frame, *columns) -> list[tuple]:
    """Sorted tuples of a frame."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)
