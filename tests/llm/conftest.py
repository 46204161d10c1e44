import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts with exact and near copies, shared passages, junk, empty ones and nulls, as (doc_id, text)."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "er", "th", "on", "é", "st", "ing", "ß", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    passage = text(40)
    rows = []
    for i in range(60):
        t = text(rng.choice([1, 3, 20, 80, 300]))
        if i % 7 == 0:
            t = f"{t} {passage} {text(10)}"
        rows.append((i, t))
    rows += [(100 + i, rows[i][1]) for i in (3, 4, 5, 7)]  # exact copies
    for i in (10, 11, 12, 13, 14, 21):  # near copies: one word changed
        near = rows[i][1].split(" ")
        near[len(near) // 2] = "changed"
        rows.append((200 + i, " ".join(near)))
    return [*rows, (300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE two"), (305, "a" * 5000), (306, ("x y " * 3000)), (307, "漢字 and ☃ 12.34"), (308, "\x00\x01 odd")]
