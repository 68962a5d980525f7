"""Plain models of the operators' contracts, and documents that hold their edge cases."""

import hashlib
import random
import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, hash long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, start=0):
    """Documents with an extra column, and one whose name operators use inside."""
    return [(start + i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), "x", i) for i, t in enumerate(texts)]


def texts(seed=1, n=60):
    """Copies, near copies, shared passages, repeats, empty and null texts, long texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    new = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [new(20) for _ in range(4)]
    out = [None, "", " \n\t", "one", "one two", "One TWO", "a " * 40, "x" * 300, "é" * 60, "<|endoftext|> end", new(4000)]
    while len(out) < n:
        kind = rng.randrange(5)
        if kind == 0 and len(out) > 12:
            out.append(rng.choice(out))
        elif kind == 1:
            w = (rng.choice([t for t in out if t and len(t) > 100])).split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(new(rng.randint(1, 30)) + " " + rng.choice(shared) + " " + new(rng.randint(0, 30)))
        else:
            out.append(new(rng.randint(1, 120)))
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(docs):
    """doc_id -> (number of grams, least doc_id of its component)."""
    sets = {}
    for i, text, *_ in docs:
        w = WORD.findall(lowered(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(docs, span=50):
    """doc_id -> (bytes, bytes removed, runs removed, digest of the rest)."""
    first = {}
    for i, text, *_ in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        for k in range(len(b) - span + 1):
            first.setdefault(b[k : k + span], i)
    out = {}
    for i, text, *_ in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                gone[k + 1 : k + span + 1] = True
        rest = bytes(c for c, g in zip(b, gone[1:-1], strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest())
    return out
