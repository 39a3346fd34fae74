"""Plain definitions that tests hold the engine against."""


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def occurrences(word, segments):
    return sum(s.startswith(word, i) for s in segments for i in range(len(s) - len(word) + 1)) if word else 0


def inside(word, segments):
    return any(word in s for s in segments)


def ms(read, segments):
    out = []
    for p in range(len(read)):
        n = 0
        while p + n < len(read) and inside(read[p : p + n + 1], segments):
            n += 1
        out.append(n)
    return out


def left(read, segments):
    out = []
    for p in range(len(read)):
        n = 0
        while n <= p and inside(read[p - n : p + 1], segments):
            n += 1
        out.append(n)
    return out


def zml(read, segments):
    out, p, lefts = [0] * len(read), len(read) - 1, left(read, segments)
    while p >= 0:
        n = lefts[p]
        for q in range(p - n + 1, p + 1):
            out[q] = p - q
        p -= max(n, 1)
    return out


def mems(read, segments, least):
    m = ms(read, segments)
    found = [(p, p + n) for p, n in enumerate(m) if n >= least and (p == 0 or m[p - 1] < n + 1)]
    return [(s, e, occurrences(read[s:e], segments)) for s, e in found]


def tokens(read, segments, k):
    lefts, out, e = left(read, segments), [], len(read) - 1
    while e >= k - 1:
        n = lefts[e]
        if n >= k:
            start = e - n + 1
            out.append((start, n - k + 1))
            e = start + k - 2
        else:
            e -= 1
    return out


def suffixes(text):
    """Places in suffix order; ``$`` ends the text and is least."""
    return sorted(range(len(text)), key=lambda i: text[i:])


def transform(text):
    sa = suffixes(text)
    c = [text[i - 1] for i in sa]
    at = {p: r for r, p in enumerate(sa)}
    return sa, c, [at[(p - 1) % len(text)] for p in sa]


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def pml(read, text, places=False):
    """The walk by its definition, with the first least common prefix between two runs as threshold; ``places``: the
    suffixes of the rows before each LF step instead."""
    sa, c, lf = transform(text)
    n = len(text)
    lcps = [0] + [lcp(text[sa[i - 1] :], text[sa[i] :]) for i in range(1, n)]
    row, length, out, seen = n - 1, 0, [], []
    for base in reversed(read):
        if base not in "ACGT" or base not in c:
            length = 0  # the row stays, and the LF step is taken
        elif c[row] == base:
            length += 1
        else:
            length = 0
            up = next((r for r in range(row, -1, -1) if c[r] == base), None)
            down = next((r for r in range(row, n) if c[r] == base), None)
            if up is None:
                row = down
            elif down is None:
                row = up
            else:
                cut = min(range(up + 1, down + 1), key=lambda r: (lcps[r], r))
                row = down if row >= cut else up
        out.append(length)
        seen.append(sa[row])
        row = lf[row]
    return seen[::-1] if places else out[::-1]
