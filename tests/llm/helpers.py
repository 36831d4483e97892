"""Plain versions of what the operators compute, word by word."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    """{id: least id reachable} for {id: set}, all pairs compared."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: root(i) for i in ids}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed=3, families=12, members=8, size=60):
    """Texts in families of edited copies, with exact copies, short, empty and null ones."""
    import random

    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, size))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                base = w
            out.append(" ".join(w))
    out += ["", None, "one", "One", "one two", "ONE  two\n", " \t", "x " * 500]
    return list(enumerate(out))
