"""Made-up crowds for the tests."""

import random



def crowd(start: int, n: int, words: int = 150):
    """Near copies of one text with 0 to 5 changed words each."""
    r = random.Random(start)
    base = [f"w{r.randrange(400)}x{start}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for k in range(i % 6):
            t[r.randrange(words)] = f"c{i}_{k}"
        out.append((start + i, " ".join(t)))
    return out
