"""Filter audit: diagrams against direct counting."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import brute
from weekcast.llm import filter_audit as fa


def counted(masks, letters, size):
    """The audit's rows by counting masks (set, weight) directly."""
    def total(test):
        return tuple(sum(w[i] for m, w in masks if test(m)) for i in range(size))

    removed = {}
    out = []
    for order in permutations(letters):
        for k, x in enumerate(order):
            before = set(order[:k])
            here = total(lambda m: x in m and not m & before)
            removed[x] = removed.get(x, 0) + here[0]
            out.append(("".join(order), k + 1, total(lambda m: not m & (before | {x}))[0], here[0],
                        total(lambda m: x in m and m & before)[0], total(lambda m: m == {x})[0], here[1:], x))
    return sorted((*r[:7], removed[r[7]]) for r in out)


@pytest.mark.parametrize("letters", ["A", "AB", "ABC", "ABCDE"])
def test_diagram_equals_counting(letters):
    rng = random.Random(len(letters))
    for share in (1.0, 0.4, 0.0):
        masks = {frozenset(c for i, c in enumerate(letters) if m >> i & 1): (rng.randint(1, 3), rng.randint(0, 2))
                 for m in range(1 << len(letters)) if rng.random() < share}
        assert sorted(fa.audit_rows(letters, masks, 2)) == counted(list(masks.items()), letters, 2)


def test_every_order_comes_up_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in fa.swap_sequence(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_diagram_is_reduced_after_swaps():
    """Equal functions are one node: a mask that depends on few variables stays small."""
    masks = {frozenset(c for i, c in enumerate("ABCDE") if m >> i & 1): (1 if m & 1 else 2,) for m in range(32)}
    d = fa.Diagram("ABCDE", masks, 1)
    for level in fa.swap_sequence(5):
        d.swap(level)
        at = d.order.index("A")
        assert [len(x) for x in d.levels] == [1 if k <= at else 2 for k in range(5)]
        assert d.weight[d.root] == (48,)
        assert len(d.child) == sum(len(x) for x in d.levels)


def test_audit_of_frames(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "en", "de"]), *[rng.choice([None, True, False]) for _ in range(4)])
            for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, n boolean, part boolean, f_A boolean, good boolean")
    got = fa.audit(df, F.col("lang"), {"A": F.col("n"), "B": F.col("part"), "C": F.col("f_A")},
                   {"good": F.col("good")}).collect()
    for part in ("", "en", "de"):
        masks = [({c for c, v in zip("ABC", r[1:4]) if v}, (1, int(bool(r[4])))) for r in rows if (r[0] or "") == part]
        mine = sorted((*r[1:7], (r.good_lost,), r.shapley) for r in got if r.part == part)
        assert mine == counted(masks, "ABC", 2)
    assert len(got) == 3 * 18
    assert fa.audit(df.limit(0), F.col("lang"), {"A": F.col("n")}, {}).count() == 0


def test_corpus_filters(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, ""), (None, ""), (4, "a " * 100), (4, "a " * 100), (9, "ABC def"), (8, "ABC def"),
            (10, "word " * 5 + "|"), (11, " x\x0bY\x1f z"), (12, " ".join(f"w{i}" for i in range(30_000)))]
    rows += [(20 + i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(120))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, A int, digest string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    marked, fails, outcomes = fa.corpus_filters(docs, labels)
    got = marked.select("id", *[c.alias(f"f{k}") for k, c in fails.items()],
                        *[F.coalesce(c, F.lit(False)).alias(k) for k, c in outcomes.items()]).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = brute.words(t)
        same = [j for j, u in rows if (u or "") == t and j is not None]
        want.append((i, len(w) < 100, 100 * len(set(w)) < 80 * len(w),
                     100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
                     i is not None and i > min(same), i == 4, i == 4))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
