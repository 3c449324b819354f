"""Language identification of mixed texts by Viterbi decoding (operator 8).

Every word (a run of letters) is scored under each language by the character trigrams
centred on its letters; the script of its first letter narrows the languages to those that
were seen to use that script.  A Viterbi path over the words, with a penalty for every
switch of language, labels spans of the text; a text's language is that of most letters.

Training counts the trigrams of at most about ``TRAIN_DOCS`` whole documents a language,
chosen by a hash of the id, in the tasks; what reaches the driver is one row for each
language and trigram bucket (``2 ** BUCKET_BITS``), whatever the number of documents.

Defined results: a null text or one without a letter is ``und`` with score 0; a training row
needs a text and a language; without any training row every text is ``und``; rows that
repeat an id are predicted one by one; ties go to the first language in code point order;
an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import arrow_rows, bounded_batches, private, str_texts

#: Most letters times languages whose scores are held at a time (a task's memory).
CELLS = 1 << 23
TRAIN_DOCS = 3000
BUCKET_BITS = 16
SWITCH = 12.0
SCRIPT_SHARE = 0.01

#: Script ranges (first and last code point) by name; letters elsewhere are "other".
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
OTHER = len(SCRIPTS) + 1


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number (0: no letter) and lower case of each code point of the first plane."""
    script = np.zeros(1 << 16, dtype=np.uint8)
    lower = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            script[c] = OTHER
            low = ch.lower()
            if len(low) == 1 and ord(low) < 1 << 16:
                lower[c] = ord(low)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, z in ranges:
            part = script[a:z + 1]
            part[part > 0] = number
    return script, lower


def letters_of(texts: list[str | None], tables) -> tuple[np.ndarray, ...]:
    """Of all texts in a row: position of each letter, its script, its trigram bucket, the
    text it is in, and the first letter of each word (an index into the letters)."""
    script_of, lower = tables
    parts, sizes = [], []
    for t in texts:
        points = np.frombuffer(((t or "") + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
        parts.append(points)
        sizes.append(len(points))
    points = np.concatenate([np.zeros(1, dtype=np.uint32), *parts, np.zeros(1, dtype=np.uint32)])
    first_plane = np.minimum(points, (1 << 16) - 1)
    script = script_of[first_plane]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        script[far] = [OTHER if chr(c).isalpha() else 0 for c in points[far].tolist()]
    low = np.where(points < 1 << 16, lower[first_plane], points)
    low[script == 0] = 0
    at = np.flatnonzero(script)
    mixed = (low[at - 1] * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA77)) + low[at + 1] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    bounds = 1 + np.concatenate(([0], np.cumsum(sizes)))
    text = np.searchsorted(bounds, at, side="right") - 1
    starts = np.flatnonzero(np.diff(at, prepend=-5) != 1) if len(at) else np.zeros(0, dtype=np.int64)
    return at - bounds[text], script[at], bucket, text, starts


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str,
          train_docs: int = TRAIN_DOCS) -> dict:
    """Model from the rows of ``docs`` that have a text and a language."""
    lang = F.col(f"`{lang_col}`").cast("string")
    usable = docs.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"),
                         F.col(f"`{text_col}`").alias("text")).filter("text is not null and lang is not null")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    langs = {r["lang"]: r["n"] for r in counts.collect()}  # one row a language
    names = sorted(langs)
    model = {"langs": names, "tables": letter_tables()}
    if not names:
        return model
    share = F.element_at(F.create_map(*[x for k in names for x in (
        F.lit(k), F.lit(min(1.0, train_docs / langs[k])))]), F.col("lang"))
    sample = usable.filter(unit < share).select("lang", "text")
    tables = model["tables"]
    size = (1 << BUCKET_BITS) + OTHER + 1

    def count(batches):
        sums: dict = {}
        for batch in batches:
            texts, of = str_texts(batch.column(1)), batch.column(0).to_pylist()
            _, script, bucket, text, _ = letters_of(texts, tables)
            for k in set(of):
                mine = np.isin(text, [i for i, x in enumerate(of) if x == k])
                add = np.bincount(bucket[mine], minlength=size)
                add[1 << BUCKET_BITS:] += np.bincount(script[mine], minlength=OTHER + 1)
                sums[k] = sums.get(k, 0) + add
        for k, total in sums.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(on)), pa.array(on.astype(np.int32)), pa.array(total[on])],
                names=["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    found = sample.mapInArrow(count, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((size, len(names)))
    column = found["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(dtype=np.int64)
    table[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
    grams, scripts = table[:1 << BUCKET_BITS] + 0.5, table[1 << BUCKET_BITS:]
    scores = np.log(grams / grams.sum(axis=0))
    scores -= scores.max(axis=1, keepdims=True)
    model["scores"] = np.maximum(scores, -6.0).astype(np.float32)
    model["allowed"] = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    return model


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several sequences (their scores in a row, ``counts`` words each).

    All sequences advance together, the long ones on alone at the end.
    """
    n, langs = scores.shape
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first, length = first[order], counts[order]
    label = np.zeros(n, dtype=np.int16)
    if not len(order):
        return label
    active = len(order) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1), side="left")
    stay = np.ones((n, langs), dtype=bool)
    come = np.zeros(n, dtype=np.int16)
    total = scores[first].copy()
    for t in range(1, int(length[0])):
        a = active[t]
        now, at = total[:a], first[:a] + t
        best = now.argmax(axis=1)
        top = now[np.arange(a), best][:, None] - switch
        stay[at] = now >= top
        come[at] = best
        total[:a] = np.maximum(now, top) + scores[at]
    state = total.argmax(axis=1)
    label[first + length - 1] = state
    for t in range(int(length[0]) - 1, 0, -1):
        a = active[t]
        at = first[:a] + t
        now = label[at]
        label[at - 1] = np.where(stay[at, now], now, come[at])
    return label


def predict(texts: list[str | None], model: dict) -> tuple[list, list, list]:
    """Language, share of its letters, and spans ``lang:start:end`` (code points) of texts.

    Texts are read in groups of about ``CELLS`` letters times languages, or one by one.
    """
    out: tuple[list, list, list] = ([], [], [])
    most = CELLS // max(1, len(model["langs"]))
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > most:
            for into, part in zip(out, _predict(group, model), strict=True):
                into += part
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    for into, part in zip(out, _predict(group, model), strict=True):
        into += part
    return out


def _word_scores(scores: np.ndarray, bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the letters' scores of each word; letters are looked up ``CELLS`` at a time."""
    out = np.empty((len(starts), scores.shape[1]), dtype=scores.dtype)
    lo, most = 0, max(1, CELLS // scores.shape[1])
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most)))
        end = starts[hi] if hi < len(starts) else len(bucket)
        out[lo:hi] = np.add.reduceat(scores[bucket[starts[lo]:end]], starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return out


def _predict(texts: list[str | None], model: dict) -> tuple[list, list, list]:
    names = model["langs"]
    n = len(texts)
    if not names:
        return ["und"] * n, [0.0] * n, [""] * n
    at, script, bucket, text, starts = letters_of(texts, model["tables"])
    if not len(at):
        return ["und"] * n, [0.0] * n, [""] * n
    # a word's score is a sum over its letters; a sum over a text of any length stays in its words
    word = _word_scores(model["scores"], bucket, starts)
    allowed = model["allowed"][script[starts]]
    word = np.where(allowed | ~allowed.any(axis=1, keepdims=True), word, np.float32(-100.0))
    of = text[starts]
    label = viterbi(word, np.bincount(of, minlength=n))
    letters = np.diff(np.concatenate((starts, [len(at)])))
    share = np.zeros((n, len(names)))
    np.add.at(share, (of, label), letters)
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    lang = [names[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())]
    score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
    turn = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    last = np.concatenate((turn[1:], [len(of)])) - 1
    ends = np.concatenate((starts[1:], [len(at)])) - 1
    spans = [[] for _ in range(n)]
    for d, k, a, z in zip(of[turn].tolist(), label[turn].tolist(), at[starts[turn]].tolist(),
                          (at[ends[last]] + 1).tolist()):
        spans[d].append(f"{names[k]}:{a}:{z}")
    return lang, score.tolist(), [",".join(s) for s in spans]


def identify(docs: DataFrame, model: dict, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """``docs`` and, under ``prefix``, ``lang_pred``, ``score`` and ``spans``."""
    p = private(docs) if prefix is None else prefix
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(f"{p}lang_pred", T.StringType(), False),
              T.StructField(f"{p}score", T.DoubleType(), False),
              T.StructField(f"{p}spans", T.StringType(), False)]
    return arrow_rows(docs, [text_col], lambda a: predict(str_texts(a[0]), shared.value), fields)


def held_out(ident):
    """Whether a row is kept from training: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))
