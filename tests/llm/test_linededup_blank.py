"""Blank lines and blanks at the ends of lines: as all pairs of places say, and in linear time."""

import random
import time

from plait.llm import linededup
from tests.llm.test_linededup import brute


def deleted(spark, rows, **how):
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return sorted(((str(r.doc_id), r.n_lines, r.deleted, r.text) for r in linededup.dedup(d, **how).collect()), key=str)


def test_blank_lines_against_brute_force(spark):
    rng = random.Random(5)
    for seed in range(2):
        pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(6)] + [""] * (6 + 6 * seed)
        blocks = [[rng.choice(pool) for _ in range(rng.randint(5, 25))] for _ in range(5)]
        rows = []
        for i in range(40):
            lines = [""] * rng.randint(0, 3)
            for _ in range(rng.randint(0, 4)):
                lines += rng.choice(blocks) + [""] * rng.randint(0, 4) + [rng.choice(pool)]
            rows.append((i, "\n".join(lines)))
        got = deleted(spark, rows, shingle_words=3, window_words=6)
        assert got == brute(rows, 6) and sum(len(r[2]) for r in got) > 100


def test_blanks_of_any_kind_at_the_ends(spark):
    lines = [f"line {k} of a passage that repeats" for k in range(10)]
    for end in ("\r", "\t", " \t\r", "　", "\xa0", "\x85"):
        rows = [(1, "\n".join(lines)), (2, "".join(f"{x}{end}\n" for x in lines)), (3, "\n".join(end + x for x in lines))]
        got = deleted(spark, rows)
        assert [r[2] for r in got] == ["", ",".join(map(str, range(10))), ",".join(map(str, range(10)))], repr(end)


def test_mostly_blank_lines_in_linear_time(spark):
    def text(blanks):
        return "\n".join(f"word{k}" + "\n" * blanks for k in range(40))

    deleted(spark, [(1, text(1)), (2, text(1))])
    for blanks in (400, 4000):  # 16,000 and 160,000 lines
        began = time.time()
        got = deleted(spark, [(1, text(blanks)), (2, text(blanks))])
        assert time.time() - began < 30
        assert got[0][2] == "" and got[1][2].count(",") == got[1][1] - 1
