import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_ string"


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, odd blanks, copies, long ones and secrets."""
    rng = random.Random(7)
    words = ["the", "of", "Straße", "niño", "año", "thble", "erand", "re-do", "x1", "42", "tion,", "é́", "Ω", "a b", "and."]
    out = [None, "", " \t\n", "one", "one two", "ONE  two", "the of the of the", "\x00 nul \x0b vt \x0c ff \x1c fs", "<|endoftext|> and <|startoftext|>x", "ﬁne ﬁne", "İstanbul İ"]
    for k in range(60):
        out.append(" ".join(rng.choice(words) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randint(1, 90))) + rng.choice(["", "\n", " .", "\r\n"]))
    out += [out[20], out[20], out[21] + " x", "word " * 6000]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids are not in order; source and lang hold nulls; one column's name is like another's."""
    rows = [((i * 37) % 101 + (1 << 40) * (i % 3), t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)
