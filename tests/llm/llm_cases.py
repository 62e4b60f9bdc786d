"""Fixed texts for the tests of the llm operators."""


def prose(seed, words=120):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(words))


#: Nulls, empties, white space, ties, repeated rows, long and accented texts.
ODD = [(None, "null id"), (None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "Éa b"), (5, "x" * 5000), (6, "word " * 3000), (7, "Éa  b "), (7, "Éa  b "), (8, "other"), (8, "Éa b")]
