"""Line dedup against a brute-force reading of its definition."""

import random

import pytest

from weekcast.llm import line_runs
from weekcast.llm.queries import QUERIES  # noqa: F401 - ships the modules

SPACE = " \t\n\x0b\x0c\r"


def words(line):
    return len([w for w in "".join(" " if c in SPACE else c for c in line).split(" ") if w])


def brute(rows, min_words):
    """rows: (id, text) in stored order; the cleaned texts."""
    kept = []
    for r, (ident, text) in enumerate(rows):
        if text is not None:
            lines = text.split("\n")
            kept.append((ident is None, ident if ident is not None else 0, r,
                         [(p, x) for p, x in enumerate(lines) if words(x)], lines))
    kept.sort(key=lambda x: x[:3])
    out = {r: t for r, (_, t) in enumerate(rows)}
    spans, places = {}, {}  # the places of a line, in the order of the corpus
    for d, (_, _, r, seq, _) in enumerate(kept):
        for s in range(len(seq)):
            longest = 0  # over every earlier place, how many lines agree
            for e, es in places.get(seq[s][1], []):
                other, size = kept[e][3], 0
                while s + size < len(seq) and es + size < len(other) and seq[s + size][1] == other[es + size][1]:
                    size += 1
                longest = max(longest, size)
            if sum(words(x) for _, x in seq[s:s + longest]) >= min_words:
                spans.setdefault(r, set()).update(range(s, s + longest))
            places.setdefault(seq[s][1], []).append((d, s))
    for _, _, r, seq, lines in kept:
        if r in spans:
            gone = {seq[i][0] for i in spans[r]}
            for i in spans[r]:  # lines without a word between deleted lines
                if i + 1 in spans[r]:
                    gone.update(range(seq[i][0], seq[i + 1][0]))
            out[r] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return [out[r] for r in range(len(rows))]


def run(spark, rows, min_words):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, n long").coalesce(1)
    got = line_runs.remove_repeated_runs(docs, min_words=min_words)
    assert got.columns == ["doc_id", "text", "n"]
    return [r.text for r in sorted(got.collect(), key=lambda r: r.n)]


def test_random_corpora_match_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(8)]
    pool += ["", "  "]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split("\n")
            a = rng.randint(0, len(other))
            text[rng.randint(0, len(text)):0] = other[a:a + rng.randint(1, 6)]
        rows.append((i, "\n".join(text)))
    for least in (1, 4, 9):
        assert run(spark, rows, least) == brute(rows, least)


def test_nulls_empties_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (3, None), (4, ""), (5, f"x\n{long}\ny"), (5, f"x\n{long}\ny"),
            (2, f"{long}\nshort tail"), (7, f"{long}\nshort tail\nown"), (8, "short tail")]
    got = run(spark, rows, 50)
    assert got == brute(rows, 50)
    assert got[0] == "" and got[1] is None and got[2] == ""
    assert got[5] == rows[5][1]                 # the smallest id is the earliest copy
    assert got[6] == "own"                      # short lines of the run go with it
    assert got[7] == "short tail"               # too short to be a run


def test_self_repetition_and_long_text(spark):
    block = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcde"]
    rows = [(1, "\n".join(block * 40)), (2, "\n".join(block * 3 + ["end"]))]
    got = run(spark, rows, 50)
    assert got == brute(rows, 50)
    assert got[0] == "\n".join(block) and got[1] == "end"


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, _w_row long, r long, row string")
    assert line_runs.remove_repeated_runs(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long, 5, 6, "a"), (2, long, 7, 8, None)],
                                 "doc_id long, text string, _w_row long, r long, row string")
    got = sorted(line_runs.remove_repeated_runs(docs).collect())
    assert [tuple(r) for r in got] == [(1, long, 5, 6, "a"), (2, "", 7, 8, None)]


@pytest.mark.parametrize("copies", [300])
def test_hot_passage_is_kept_once(spark, copies):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"{passage}\nown line {i}") for i in range(copies)]
    got = run(spark, rows, 50)
    assert got[0] == rows[0][1] and got[1:] == [f"own line {i}" for i in range(1, copies)]


def test_the_longest_run_of_any_earlier_copy_goes(spark):
    x, y, z = " ".join(["x"] * 50), " ".join(["y"] * 20), "z z"
    rows = [(1, x), (2, f"{x}\n{y}"), (3, f"{x}\n{y}"), (4, f"{x}\n{y}\n{z}"), (5, f"{x}\n{z}\nown"),
            (6, f"{x}\n{y}\n{z}\nmore")]
    got = run(spark, rows, 50)
    assert got == brute(rows, 50)
    assert got == [x, y, "", z, f"{z}\nown", "more"]
