"""A small table of odd rows with the columns of documents and others whose names operators use inside."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, row string, n long, spans string, "
          "items string, grade string, label string, score string, key string, digest string, number int, size int, `__text` string, kept string")


def words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice("alpha Beta gamma delta épsilon zeta ÊTA theta iota kappa lambda mu nu xi".split()) + str(pick.randint(0, 40))
                    for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 300)
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, " ".join(base.split())), (5, base.replace(" ", "\n", 5)),
        (6, base + " tail"), (7, "start " + base), (8, None), (9, ""), (10, " \t\r\n\x0b\x0c "), (11, "one"), (12, "one two three"),
        (13, "One  two\nthree"), (14, words(2, 6000)), (15, words(2, 6000) + " x"), (16, "a" * 30_000), (17, "ß" * 501 + "🙂" * 77),
        (18, "  lead and  double   spaces \n\n here \n "), (19, "▁odd▁marks ▁▁ of▁ space"), (20, "<|endoftext|> in text <|endoftext|>"),
        (21, "\x1c\x85  　tabs\there there"), (22, "12345 67 8.9 !!! ... ### don't we'll 漢字かな交じり文 русский"),
        (23, "\x00null\x00 char"), (24, "<s> </s> <unk> <0x41>"), (25, words(3, 40)), (25, words(3, 40)), (26, words(3, 39) + " other"),
        (27, "\n\n"), (28, "."), (None, "no id here"), (None, base)]
    return [(i, t, "en" if i and i % 2 else None, None, None, 7, "r", 1, "s", "i", "g", "l", "sc", "k", "d", 1, 2, "t", "x") for i, t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
