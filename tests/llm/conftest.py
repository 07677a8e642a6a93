import random

import pytest


@pytest.fixture(scope="session")
def noisy_docs():
    """Ids with texts: shared passages, copies, near copies, runs, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(17)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "the", "of", "x", "É", "zeta9", "||", "tau"]) + rng.choice(["", "", "s", "12"])
    text = lambda n: rng.choice([" ", "\n", "\t"]).join(word() for _ in range(n))
    passages = [text(rng.randint(45, 90)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    for i in range(120, 170):
        words = rows[rng.randint(0, 5)][1].split(" ")
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[7][1]) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two three"), (304, "ONE two three"), (305, "a b"), (306, "spam " * 300), (307, "spam " * 200),
             (308, "ham eggs " * 120), (309, "ham eggs " * 70), (310, text(6000)), rows[3], rows[3], (None, rows[9][1]), (None, None)]
    rng.shuffle(rows)
    return rows
