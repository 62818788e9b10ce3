"""Plain versions of operators, one pair or window at a time."""

from collections import Counter

from xxhash import xxh64_intdigest


def fingerprint(text):
    w = (text or "").encode().lower().split()
    hs = [xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, distance=3):
    """Smallest reachable position of each fingerprint."""
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def repeated(raw, t):
    """Per byte string the mask of bytes covered by a window that starts twice."""
    seen = Counter()
    for b in raw:
        seen.update(b[i:i + t] for i in range(len(b) - t + 1))
    masks = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - t + 1):
            if seen[b[i:i + t]] > 1:
                gone[i:i + t] = b"\1" * t
        masks.append(gone)
    return masks
