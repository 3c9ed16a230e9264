import random

WORDS = ["alpha", "beta", "Gamma", "delta", "éclair", "naïve", "zeta", "eta", "x", "über", "omega", "rho", "sigma", "tau", "pi"]


def corpus(seed: int, n: int, low: int = 0, high: int = 60):
    """(id, text) rows: unrelated texts, exact copies, near copies, shared passages, nulls, empty and short ones."""
    r = random.Random(seed)
    word = lambda: r.choice(WORDS) + str(r.randint(0, 400))
    passages = [" ".join(word() for _ in range(14)) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.15:
            text = r.choice(rows)[1]
        elif rows and kind < 0.4 and (old := r.choice(rows)[1]):
            words = old.split(" ")
            for _ in range(r.randint(1, 2)):
                words[r.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.45:
            text = r.choice([None, "", "  \n ", "one two", "One TWO"])
        else:
            words = [word() for _ in range(r.randint(low, high))]
            if kind > 0.8:
                words[len(words) // 2 : len(words) // 2] = [r.choice(passages)]
            text = r.choice([" ", "\n", "  "]).join(words)
        rows.append((i, text))
    return rows
