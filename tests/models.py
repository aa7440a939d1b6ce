"""Plain-Python models that tests compare with."""


def sequential_two_key(rows, stored1=(), stored2=()):
    """Plain-Python model of M1 (used by tests): rows are (ordinal, k1, k2)."""
    taken1, taken2 = set(stored1), set(stored2)
    kept = []
    for o, a, b in sorted(rows, key=lambda r: r[0]):
        if (a is not None and a in taken1) or (b is not None and b in taken2):
            continue
        kept.append(o)
        if a is not None:
            taken1.add(a)
        if b is not None:
            taken2.add(b)
    return kept
