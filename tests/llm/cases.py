"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names are those of results and of the operators' own columns.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _fp string, _row int, hits string, score int, `a.b` int, `x y` string, `q``t` int"


def words(rng: random.Random, n: int, letters: str = "abcde") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = [
        (1, None, None, None, None),
        (None, "no id but words here", "en", None, 5),
        (None, None, None, "a", None),
        (2, "", "en", "a", 0),
        (3, "   \n\t \n", "en", "a", 6),
        (4, "!!! ??? ...", "de", "b", 11),
        (5, "one", "en", "a", 3),
        (6, "two words", "en", "a", 9),
        (7, "Ünïcödé wörds, 中文 字 and 🙂 emoji nbsp ​ \x1c sep", "fr", "b", 1),
        (8, words(rng, 6000), "en", "hot", 1),
        (9, "x" * 30_000, "en", "hot", 1),
        (9, "x" * 30_000, "en", "hot", 1),
    ]
    for i in range(10, 60):
        rows.append((i, words(rng, rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", None]), i))
    same = words(rng, 25)
    rows += [(i, same, "en", "hot", 7) for i in range(60, 80)]
    rows += [rows[20], rows[20], rows[20]]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def clashing(spark):
    """The awkward rows with further columns of the operators' own names."""
    return widened(spark, awkward_rows())


def widened(spark, rows):
    return spark.createDataFrame([(*r, "w", "f", 1, "h", 2, 3, "y", 4) for r in rows], CLASHING)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(value):
    return "" if value is None else str(value)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(plain, r)))
