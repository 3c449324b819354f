"""Filter interaction audit by decision diagrams (operator 13).

Each document fails a set of filters, its *mask*.  Documents are counted by (part, mask,
outcomes): at most ``2 ** filters`` masks a part, combined before the shuffle, so a part with a
third of all rows is no hot spot.  Everything else is read off the counts of one part.

A part's diagram has a level for each filter, in some order; a node's two children are the
documents that pass and that fail the filter, equal nodes are one, and every node weighs the
documents below it.  Neighbouring levels are swapped in place: only the nodes of two levels
change, and nodes above keep their identity and weight.  A sequence of such swaps
(Steinhaus-Johnson-Trotter) visits every order of the filters once.  In each order the
all-pass path from the root gives the steps: a filter keeps what its pass child weighs and
removes what its fail child weighs; passing all the rest below that fail child leads to what
fails this filter alone.

Defined results: the filters and outcomes are boolean columns, null counts as false; the null
part is the empty string; rows are counted one by one, repeated or not; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import materialize
from weekcast.llm.digest_index import digest_of

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Diagram:
    """A count-weighted decision diagram, one node level for each variable.

    ``counts`` gives the weight (a tuple) of a set of failed variables; sets that are missing
    weigh nothing.
    """

    def __init__(self, variables, counts: dict[frozenset, tuple], size: int):
        self.order = list(variables)
        self.child: dict[int, tuple[int, int]] = {}  # node -> (pass, fail)
        self.weight: list[tuple] = []
        self._ends: dict[tuple, int] = {}
        self.levels: list[set[int]] = [set() for _ in self.order]
        none = (0,) * size

        def make(level: int, failed: frozenset, seen: list[dict]) -> int:
            if level == len(self.order):
                w = counts.get(failed, none)
                if w not in self._ends:
                    self._ends[w] = self._node(w)
                return self._ends[w]
            ways = (make(level + 1, failed, seen), make(level + 1, failed | {self.order[level]}, seen))
            return self._shared(level, ways, seen[level])

        self.root = make(0, frozenset(), [{} for _ in self.order])

    def _node(self, weight: tuple) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _shared(self, level: int, ways: tuple[int, int], seen: dict) -> int:
        """The node of a level with these children: one for equal children."""
        if ways not in seen:
            node = self._node(tuple(a + b for a, b in zip(*(self.weight[w] for w in ways), strict=True)))
            self.child[node] = ways
            self.levels[level].add(node)
            seen[ways] = node
        return seen[ways]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the one below it."""
        old, self.levels[level + 1], seen = self.levels[level + 1], set(), {}
        for node in self.levels[level]:
            (pp, pf), (fp, ff) = (self.child[c] for c in self.child[node])
            self.child[node] = (self._shared(level + 1, (pp, fp), seen), self._shared(level + 1, (pf, ff), seen))
        for node in old:
            del self.child[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple]:
        """(variable, weight kept, weight removed, weight failing it alone) along the all-pass path."""
        out, node = [], self.root
        for variable in self.order:
            kept, alone = self.child[node]
            removed = self.weight[alone]
            while alone in self.child:
                alone = self.child[alone][0]
            out.append((variable, self.weight[kept], removed, self.weight[alone]))
            node = kept
        return out


def swap_sequence(n: int):
    """Levels to swap with the next one, so that every order of ``n`` levels comes up once."""
    place = list(range(n))
    ahead = [-1] * n
    while True:
        moving = [v for v in range(n) if 0 <= place.index(v) + ahead[v] < n
                  and place[place.index(v) + ahead[v]] < v]
        if not moving:
            return
        v = max(moving)
        i = place.index(v)
        j = i + ahead[v]
        yield min(i, j)
        place[i], place[j] = place[j], place[i]
        for w in range(v + 1, n):
            ahead[w] = -ahead[w]


def audit_rows(letters: str, counts: dict[frozenset, tuple], size: int) -> list[tuple]:
    """(order, step, kept, removed, redundant, alone, removed weights after the first, total of
    removed over all orders) of every order and step; the first weight counts documents."""
    diagram = Diagram(letters, counts, size)
    found = {"".join(diagram.order): diagram.steps()}
    for level in swap_sequence(len(letters)):
        diagram.swap(level)
        found["".join(diagram.order)] = diagram.steps()
    failing = {steps[0][0]: steps[0][2][0] for steps in found.values()}
    total = dict.fromkeys(letters, 0)
    for steps in found.values():
        for variable, _, removed, _ in steps:
            total[variable] += removed[0]
    return [(order, k + 1, kept[0], removed[0], failing[v] - removed[0], alone[0], removed[1:], total[v])
            for order, steps in found.items() for k, (v, kept, removed, alone) in enumerate(steps)]


def audit(marked: DataFrame, part, fails: dict, outcomes: dict) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, ``<outcome>_lost`` and shapley.

    ``fails`` gives a boolean column for each filter's letter: the row fails it; ``outcomes`` a
    boolean column for each name.  A part's counts, at most ``2 ** (filters + outcomes)`` rows,
    are read by one task.
    """
    letters, names = "".join(fails), list(outcomes)
    false = F.lit(False)
    flags = [F.coalesce(c, false).alias(f"f_{k}") for k, c in fails.items()]
    flags += [F.coalesce(c, false).alias(f"o_{k}") for k, c in outcomes.items()]
    rows = marked.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *flags)
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))

    def read(frame):
        import pandas as pd  # noqa: PLC0415 - in the task

        size = 1 + len(names)
        masks: dict[frozenset, list] = {}
        for row in frame.itertuples(index=False):
            failed = frozenset(k for k in letters if getattr(row, f"f_{k}"))
            into = masks.setdefault(failed, [0] * size)
            into[0] += int(row.n)
            for i, k in enumerate(names):
                into[i + 1] += int(row.n) if getattr(row, f"o_{k}") else 0
        label = frame["part"].iloc[0]
        made = [(label, *r[:6], *r[6], r[7])
                for r in audit_rows(letters, {k: tuple(v) for k, v in masks.items()}, size)]
        return pd.DataFrame(made, columns=columns)

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
               *[f"{k}_lost" for k in names], "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in columns[3:])
    return counts.groupBy("part").applyInPandas(read, schema)


def corpus_filters(docs: DataFrame, labels: DataFrame | None = None, part_col: str = "lang",
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict, dict]:
    """Documents (part, ...) with the five corpus filters and the label outcomes, for ``audit``.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % capitals A-Z; D: a
    character of ``[#$%&*|]``; E: the text of a smaller id.  A null text is empty; a null id is
    neither smaller nor larger than any other; a label counts if any of the id's rows has it.

    The texts are read once; ids, flags and digests are stored.  E joins by (digest, id): the
    rows of a text that has many copies differ in id, so the copies are spread.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    ident = F.col(f"`{id_col}`")
    rows = materialize(docs.select(
        ident.alias("id"), F.col(f"`{part_col}`").alias("part"), (n < 100).alias("A"),
        (100 * distinct < 80 * n).alias("B"), (100 * capitals > 10 * F.length(text)).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"), digest_of(F.col(f"`{text_col}`")).alias("digest")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL") \
        .withColumn("is_first", F.lit(True))
    marked = rows.join(first, ["digest", "id"], "left")
    fails = {k: F.col(k) for k in "ABCD"} | {"E": F.col("id").isNotNull() & F.col("is_first").isNull()}
    if labels is None:
        return marked, fails, {}
    each = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return marked.join(each, "id", "left"), fails, {"good": F.col("good"), "toxic": F.col("toxic")}
