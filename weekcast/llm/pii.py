"""Personal data by boosted trees over candidate spans (operator 9), DataFrame functions only.

Four fixed patterns (e-mail, IP address, payment card, phone number in international form)
give the base spans, which always stay.  Beside them generators with high recall propose
candidates that may overlap: digit groups of any punctuation, anything around an @, spelled-
out addresses, bank account numbers.  A candidate's format and the characters around it make
a short vector of small integers; gradient-boosted trees (``pyspark.ml``) learn from weak
labels what personal data looks like.  Good candidates hold a base span, or are account
numbers with a valid check (ISO 7064 mod 97-10), spelled-out addresses with a dotted domain,
or 7 to 15 digits that are no date after a word such as ``phone``; the others are bad.  For
each generator a threshold is calibrated so that at least ``PRECISION`` of its candidates above
it that overlap no base span are good; these are added as kind ``other``.

Scale.  Patterns run only on texts that have a character they need.  For training the
candidates of all documents are counted by vector before the shuffle; the table of counts is
bounded by the number of different vectors, whatever the corpus, and the trees are fitted on
it; a generator's good and bad candidates weigh the same in all, so rare ones count.  Trees are then one column expression over each document's
array of candidates: no join, no shuffle, no Python.

Offsets are code points, ends exclusive.

Patterns follow the contract's but for possessive loops, which read the same strings without
recursion or repeated starts inside one run, so long texts take linear time.

Defined results: a null or empty text has no spans; rows are scanned one by one; if all
candidates are good all are added, if all are bad none; an empty table gives an empty table; extra
columns stay.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import materialize, private

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
TREES, DEPTH = 12, 4
PRECISION = 0.98

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (what a text must have, pattern, condition on the match ``m``)
BASE = {
    "email": ("contains({t}, '@')",
              rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": ("{t} rlike '[0-9]\\\\.[0-9]'",
           r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
           "forall(split({m}, '[.]'), x -> length(ltrim('0', x)) <= 3 and "
           "coalesce(try_cast(x as int), 256) <= 255)"),
    "card": ("{t} rlike '[0-9][ -]?[0-9][ -]?[0-9]'", r"[0-9](?:[\x20-]?[0-9])++",
             "length(translate({m}, ' -', '')) between 16 and 19 and "
             "luhn_check(translate({m}, ' -', ''))"),
    "phone": ("{t} rlike '\\\\+[0-9]'", r"\+[0-9][\x20().0-9-]+[0-9]",
              "length(regexp_replace({m}, '[^0-9]', '')) between 8 and 15"),
}

#: Generators of candidates.
GENERATORS = {
    "number": ("{t} rlike '[0-9]'", r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,}+"),
    "at": ("contains({t}, '@') or {t} rlike '(?i)[(\\\\[]at[)\\\\]]'",
           r"[^\s@,;:<>()\[\]]{1,64}\s?(?:@|[(\[](?i:at)[)\]])\s?[^\s@,;:<>()\[\]]{1,64}+"),
    "account": ("{t} rlike '[A-Z]{{2}}[0-9]{{2}}'", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{8,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)\b"),
}

_MARK, _STAND_IN = "\\u0001", "\\u0003"
_WORDS = "phone|tel|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|ip|address|host|server"

#: Features of a candidate ``c``: small integers from its format and its context.
FEATURES = {
    "digits": "cast(least(length(regexp_replace(c.value, '[^0-9]', '')), 24) as int)",
    "letters": "cast(least(length(regexp_replace(c.value, '[^A-Za-z]', '')), 12) as int)",
    "at_sign": "cast(contains(c.value, '@') as int)",
    "plus": "cast(startswith(c.value, '+') as int)",
    "dots": "cast(least(length(regexp_replace(c.value, '[^.]', '')), 6) as int)",
    "dashes": "cast(least(length(regexp_replace(c.value, '[^-]', '')), 6) as int)",
    "spaces": "cast(least(length(regexp_replace(c.value, '[^ ]', '')), 6) as int)",
    "brackets": "cast(c.value rlike '[()]' as int)",
    "luhn": "cast(coalesce(luhn_check(regexp_replace(c.value, '[^0-9]', '')), false) as int)",
    "domain": "cast(c.value rlike '[A-Za-z0-9-][.][A-Za-z]{{2,}}$' as int)",
    "octets": "cast(c.value rlike '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' as int)",
    "glued_before": "cast(c.before rlike '[A-Za-z0-9_=\"/#$]$' as int)",
    "glued_after": "cast(c.after rlike '[A-Za-z0-9_=\"/%]' as int)",
    "word_before": f"cast(lower(c.before) rlike '{_WORDS}' as int)",
}

# features that the weak labels rest on
_PHONE = r"'\\b(tele)?(phone|fon|fax)|\\b(tel|call|mobile|cell)\\b'"
_BARE = "replace(c.value, ' ', '')"
FEATURES |= {
    "generator": "c.generator",
    "check": "cast(c.generator = 2 and aggregate(filter(split(concat(substring("
             f"{_BARE}, 5), left({_BARE}, 4)), ''), x -> x <> ''), 0, (a, x) -> "
             "(if(x rlike '[0-9]', a * 10 + coalesce(try_cast(x as int), 0), a * 100 + ascii(x) - 55)) % 97"
             ") = 1 as int)",
    "spelled": "cast(c.value rlike '[(\\\\[](?i:at)[)\\\\]]' as int)",
    "phone_word": f"cast(lower(c.before) rlike {_PHONE} as int)",
    "date": "cast(c.value rlike '^(19|20)[0-9][0-9][-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}' as int)",
}

#: Weak label of a candidate ``c`` that holds no base span, by generator.
GOOD = ("case c.f.generator when 2 then c.f.check = 1 when 1 then c.f.spelled = 1 and c.f.domain = 1 "
        "else c.f.phone_word = 1 and c.f.date = 0 and c.f.digits between 7 and 15 end")

_SPAN = "struct<start:int,stop:int,value:string,before:string,after:string>"


def _sql_text(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, needs: str, pattern: str) -> str:
    """SQL: the matches of a pattern, leftmost and not overlapping, with their offsets.

    The matches are put between marks (a control character that the text is rid of first,
    one for one); the pieces' lengths give the offsets.
    """
    clean = f"translate({text}, '{_MARK}', '{_STAND_IN}')"
    parts = (f"split(regexp_replace({clean}, {_sql_text(pattern)}, '{_MARK}$0{_MARK}'), '{_MARK}', -1)")
    ends = "aggregate(p, array(0), (a, x) -> array_append(a, element_at(a, -1) + length(x)))"
    # bound once each: the pieces p, the offset e of each piece
    spans = ("transform(filter(sequence(0, size(p) - 1), i -> i % 2 = 1), i -> named_struct("
             "'start', e[i], 'stop', e[i + 1], 'value', p[i], "
             "'before', right(p[i - 1], 24), 'after', left(p[i + 1], 1)))")
    with_ends = f"transform(array({ends}), e -> {spans})[0]"
    found = f"transform(array({parts}), p -> if(size(p) < 3, cast(array() as array<{_SPAN}>), {with_ends}))[0]"
    return f"if({text} is not null and ({needs.format(t=text)}), {found}, cast(array() as array<{_SPAN}>))"


def base_column(kind: str, text: str) -> str:
    """SQL: the base spans of a kind; failing matches are dropped, not tried again."""
    needs, pattern, condition = BASE[kind]
    return f"filter({_spans(text, needs, pattern)}, s -> {condition.format(m='s.value')})"


def _with_spans(docs: DataFrame, text_col: str, p: str) -> DataFrame:
    """``docs`` with arrays of base spans by kind, and of candidates with their features."""
    text = f"`{text_col}`"
    out = docs.selectExpr("*", *[f"{base_column(k, text)} as `{p}{k}`" for k in KINDS],
                          *[f"{_spans(text, *g)} as `{p}g_{n}`" for n, g in GENERATORS.items()])
    features = ", ".join(f"'{n}', {e.replace('{{', '{').replace('}}', '}')}" for n, e in FEATURES.items())
    base = ", ".join(f"`{p}{k}`" for k in KINDS)
    out = out.withColumn(f"{p}base", F.expr(
        f"transform(concat({base}), s -> named_struct('start', s.start, 'stop', s.stop))"))
    made = ", ".join(f"transform(`{p}g_{n}`, s -> named_struct('start', s.start, 'stop', s.stop, 'value', s.value, "
                     f"'before', s.before, 'after', s.after, 'generator', {k}))" for k, n in enumerate(GENERATORS))
    candidates = (f"transform(concat({made}), c -> named_struct('start', c.start, 'stop', c.stop, "
                  f"'holds', exists(`{p}base`, b -> b.start >= c.start and b.stop <= c.stop), "
                  f"'meets', exists(`{p}base`, b -> b.start < c.stop and c.start < b.stop), "
                  f"'f', named_struct({features})))")
    candidates = (f"transform({candidates}, c -> named_struct('start', c.start, 'stop', c.stop, "
                  f"'meets', c.meets, 'good', c.holds or {GOOD}, 'f', c.f))")
    return out.withColumn(f"{p}candidates", F.expr(candidates)).drop(*[f"{p}g_{n}" for n in GENERATORS])


def _tree_sql(lines: list[str], at: int, names: list[str]) -> tuple[str, int]:
    """The nested conditions of a tree's description, from line ``at`` on, as SQL."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D", at + 1
    test = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", line)
    yes, at = _tree_sql(lines, at + 1, names)
    no, at = _tree_sql(lines, at + 1, names)  # past the line of Else
    return f"if(f.{names[int(test[1])]} <= {float(test[2])!r}D, {yes}, {no})", at


def boosted_score(counts: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str | None:
    """SQL for the margin of a feature struct ``f``, learned from vectors with counts.

    ``counts``: the features, ``good`` and ``n``.  None without a good candidate, the same margin
    for all without a bad one.
    """
    totals = counts.groupBy("generator", "good").agg(F.sum("n").alias("n")).collect()  # six rows at most
    if len({r["good"] for r in totals}) < 2:
        return "0.0D" if any(r["good"] for r in totals) else None
    names = list(FEATURES)
    weight = F.lit(0.0)
    for r in totals:
        weight = F.when((F.col("generator") == r["generator"]) & (F.col("good") == r["good"]),
                        F.col("n") / F.lit(float(r["n"]))).otherwise(weight)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(
        counts.withColumn("label", F.col("good").cast("double")).withColumn("weight", weight))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, weightCol="weight",
                          minInstancesPerNode=1, maxBins=32).fit(rows)
    terms = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        terms.append(f"{float(weight)!r}D * {_tree_sql(lines, 0, names)[0]}")
    return " + ".join(terms)


def calibrated(counts: DataFrame, score: str, precision: float = PRECISION) -> dict[int, float]:
    """By generator, the lowest margin from which on at least ``precision`` of its candidates
    that overlap no base span (``free`` of ``n``) are good; generators without one are left out."""
    margin = score.replace("f.", "")
    levels = counts.withColumn("margin", F.round(F.expr(margin), 4)).groupBy("generator", "margin").agg(
        F.sum("free").alias("n"), F.sum(F.when(F.col("good"), F.col("free")).otherwise(0)).alias("good")) \
        .orderBy("generator", F.desc("margin")).collect()  # bounded by the number of vectors
    best: dict[int, float] = {}
    at = None
    for row in levels:
        if row["generator"] != at:
            at, n, good = row["generator"], 0, 0
        n, good = n + row["n"], good + row["good"]
        if good >= precision * n:
            best[at] = row["margin"]
    return best


def find_pii(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and arrays of spans (start, stop) by kind and of added ones; their prefix.

    Columns: prefix + ``email``, ``ip``, ``card``, ``phone``, ``other``.
    """
    p = private(docs)
    marked = _with_spans(docs, text_col, p)
    found = marked.select(F.explode(f"{p}candidates").alias("c")).select("c.good", "c.meets", "c.f.*")
    counts = materialize(found.groupBy("good", *FEATURES).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("meets")).alias("free")).coalesce(1)
                         .orderBy("good", *FEATURES), "pii-vectors")
    score = boosted_score(counts)
    thresholds = calibrated(counts, score) if score else {}
    if not thresholds:
        other = "filter({0}, c -> false)"
    else:
        margin = score.replace("f.", "c.f.")
        least = " ".join(f"when {g} then {m!r}D" for g, m in thresholds.items())
        other = (f"filter({{0}}, c -> not c.meets and coalesce(round({margin}, 4) >= "
                 f"case c.f.generator {least} end, false))")
    other = other.format(f"`{p}candidates`")
    merged = (f"array_sort(array_distinct(transform({other}, c -> "
              "named_struct('start', c.start, 'stop', c.stop))))")
    kinds = [f"transform(`{p}{k}`, s -> named_struct('start', s.start, 'stop', s.stop)) as `{p}{k}`"
             for k in KINDS]
    return marked.selectExpr(*[f"`{c}`" for c in docs.columns], *kinds, f"{merged} as `{p}{OTHER}`"), p


def spans_text(p: str, kinds) -> Column:
    """``kind:start:end`` of the kinds' spans, by kind and then start, comma-joined."""
    each = ", ".join(f"transform(`{p}{k}`, s -> concat_ws(':', '{k}', s.start, s.stop))" for k in kinds)
    return F.expr(f"array_join(concat({each}), ',')")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by ``[kind]`` (overlaps: the first by start)."""
    marked, p = find_pii(docs, text_col)
    every = ", ".join(f"transform(`{p}{k}`, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', '{k}'))"
                      for k in (*KINDS, OTHER))
    clean = (f"aggregate(array_sort(concat({every})), named_struct('at', 0, 'out', ''), (a, s) -> "
             f"if(s.start < a.at, a, named_struct('at', s.stop, 'out', concat(a.out, "
             f"substring(`{text_col}`, a.at + 1, s.start - a.at), '[', s.kind, ']'))), "
             f"a -> concat(a.out, substring(`{text_col}`, a.at + 1)))")
    return marked.selectExpr(*[f"{clean} as `{c}`" if c == text_col else f"`{c}`" for c in docs.columns])
