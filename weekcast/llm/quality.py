"""Host-level quality rules (operator 10).

Every document is held against a few rules; what a single document fails is weak evidence,
so the failures are counted by host (``source``), each host's failure rate of each rule is
shrunk towards the rate of all hosts with a beta prior that is fitted to the hosts
themselves, and the host's verdict is joined back: a document goes if it fails the base
rule, or if it fails a rule of which its host is found guilty.  A document that fails no
rule always stays.

Defined results: a null text has no words; a null ``source`` is a host of its own; an empty
table gives an empty table; repeated rows are judged (and counted) one by one; extra columns
stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import arrow_rows, byte_texts, fresh, materialize, private

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The rules, over the statistics of one document.
RULES = {
    "short": "{n_words} < 50",
    "repeats": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbols": "10 * {n_symbols} > {word_chars}",
    "lines": "{n_dup_lines} >= 3 and 50 * {n_dup_lines} > {n_words}",
    "word_length": "{n_words} > 0 and ({word_chars} < 3 * {n_words} or {word_chars} > 12 * {n_words})",
}
BASE_RULES = ("short", "repeats")

#: A host is guilty of a rule if its shrunk failure rate is above this.
HOST_RATE = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    pair = w[:-2] * len(ids) + w[1:-1]
    if len(ids) > 1_000_000:  # keeps the product below 2**63
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair * len(ids) + w[2:]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    covered[:-2] = twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def text_stats(data: bytes) -> tuple[int, int, int, int, int]:
    """The five statistics of one text (UTF-8), in the order of ``STATS``."""
    words = data.split()
    if not words:
        return 0, 0, int(_SYMBOL[np.frombuffer(data, dtype=np.uint8)].sum()), 0, 0
    buf = np.frombuffer(data, dtype=np.uint8)
    # code points: bytes that do not continue a character, less the white space
    spaces = np.count_nonzero((buf == 32) | ((buf >= 9) & (buf <= 13)))
    chars = len(buf) - np.count_nonzero((buf & 0xC0) == 0x80) - spaces
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), int(chars), int(np.count_nonzero(_SYMBOL[buf])),
            len(lines) - len(set(lines)), repeated_words(words))


def _batch_stats(arrays):
    rows = [text_stats(x) for x in byte_texts(arrays[0])]
    return [list(x) for x in zip(*rows, strict=True)]


def with_stats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the statistics appended, and the names they got."""
    names = {s: fresh(docs, f"_q_{s}") for s in STATS}
    fields = [T.StructField(names[s], T.LongType(), False) for s in STATS]
    return arrow_rows(docs, [text_col], _batch_stats, fields), names


def _prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Beta prior (alpha, beta) of each rule by the moments of the hosts' failure rates.

    One row of sums is all that reaches the driver.
    """
    n = F.col("_n").cast("double")
    aggs = [F.count(F.lit(1)).alias("h"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for r in rules:
        k = F.col(f"_k_{r}").cast("double")
        aggs += [F.sum(k).alias(f"k_{r}"), F.sum(k * k / n).alias(f"kk_{r}")]
    s = hosts.agg(*aggs).first()
    out = {}
    for r in rules:
        if not s["n"]:
            out[r] = (1.0, 1.0)
            continue
        m = s[f"k_{r}"] / s["n"]
        between = s[f"kk_{r}"] - s["n"] * m * m  # sum of n (rate - mean)^2
        noise = (s["h"] - 1) * m * (1 - m)
        spread = (between - noise) / max(s["n"] - s["nn"] / s["n"], 1.0)
        strength = m * (1 - m) / spread - 1 if spread > 1e-9 else 1e4
        strength = min(max(strength, 2.0), 1e4)
        out[r] = (max(m, 1e-6) * strength, max(1 - m, 1e-6) * strength)
    return out


def host_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                 host_rate: float = HOST_RATE, carry: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Returns the columns ``carry`` (all by default) and the columns ``_q_<statistic>``,
    ``_q_base_failed``, ``_q_host_guilty`` and ``_q_kept`` (more underscores in front where
    ``docs`` has such names; ``verdict_names`` gives them).

    Two passes: one aggregate by host (combined before its shuffle, so a host with a third of
    all rows is no hot spot) and the join of the verdicts.  The hosts' verdicts are written to
    the shared stage folder, so the join is planned by their size: broadcast while they are
    below Spark's threshold, else sort-merge with skewed hosts split by AQE.  Where the text is
    not carried the statistics are written too; with the text they are computed again, which
    costs less than to write and shuffle all texts.
    """
    carry = docs.columns if carry is None else carry
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, host_col, text_col])])
    marked, names = with_stats(source, text_col)
    staged = marked if text_col in carry else materialize(marked.drop(text_col), "quality")
    rules = list(RULES)
    failed = {r: F.expr(RULES[r].format(**{k: f"`{v}`" for k, v in names.items()})) for r in rules}
    host = F.col(f"`{host_col}`")
    p = private(staged)
    hosts = materialize(staged.groupBy(host.alias(f"{p}host")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(failed[r].cast("long")).alias(f"_k_{r}") for r in rules]), "quality-hosts")
    prior = _prior(hosts, rules)
    guilty = hosts.select(f"{p}host", *[
        ((F.col(f"_k_{r}") + prior[r][0]) / (F.col("_n") + sum(prior[r])) > host_rate)
        .alias(f"{p}guilty_{r}") for r in rules])
    out = verdict_names(source)
    joined = staged.join(guilty, host.eqNullSafe(F.col(f"{p}host")), "left")
    base = failed[BASE_RULES[0]] | failed[BASE_RULES[1]]
    by_host = F.lit(False)
    for r in rules:
        by_host = by_host | (failed[r] & F.coalesce(F.col(f"{p}guilty_{r}"), F.lit(False)))
    shown = [F.col(f"`{c}`") for c in carry] + [F.col(f"`{names[s]}`") for s in STATS]
    return joined.select(*shown, base.alias(out["base_failed"]), by_host.alias(out["host_guilty"]),
                         (~base & ~by_host).alias(out["kept"]))


def verdict_names(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that ``host_quality`` appends to ``docs``."""
    return {s: fresh(docs, f"_q_{s}") for s in (*STATS, "base_failed", "host_guilty", "kept")}


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they had."""
    names = verdict_names(docs)
    judged = host_quality(docs, text_col, host_col)
    return judged.filter(F.col(f"`{names['kept']}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
