"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5).

Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased (A-Z); a
test item's shingles are its 5-word sequences (an item of fewer words is one shingle).  A
document is contaminated by an item if it contains at least ``THRESHOLD`` of the item's
distinct shingles.

Search.  A short item in a long document has a tiny Jaccard similarity, so the search is
partitioned by size: an item of n distinct shingles belongs to the size class
``U = 2 ** bit_length(n)``, and for that class a document is read as overlapping windows of
``2 U`` shingles that start every ``U``.  An item that stands in the document fills at least a fifth
of some window, so with ``HASHES`` MinHash functions, one to a band, the chance that no
function has the same minimum on item and window is below 1e-8 (0.81 ** 96).  Only shingles that are the
minimum of some item can be such a common minimum; windows without one are passed over and
their other minima never computed.

Verification.  Candidates are held against the item's shingles word by word; the result is
exact containment, never an estimate.

Scale.  Documents are read once, in place, without a shuffle.  The items' index is broadcast
in blocks of ``BLOCK_BYTES`` of text; a larger benchmark takes more passes over the
documents, none of them with a larger broadcast.

Defined results: null or empty texts and items without a word match nothing; repeated
documents each give their rows; repeated items each match; empty tables give empty results
(an empty benchmark removes nothing); extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import ALNUM_BYTES, LOWER, arrow_rows, byte_texts, private, word_bounds

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 96
BLOCK_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_SPAN = 1 << 16
_UP = _powers(int(_BASE), 2 * _SPAN)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), 2 * _SPAN)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    return x ^ (x >> np.uint64(29))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and a 64-bit hash of each word."""
    low = LOWER[np.frombuffer(data, dtype=np.uint8)]
    starts, ends = word_bounds(low, ALNUM_BYTES)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + 2 * _SPAN - 1, side="right")), i + 1)
        end = int(ends[j - 1])
        chunk = low[base:end].astype(np.uint64) + np.uint64(1)
        if len(chunk) >= 2 * _SPAN:  # one word longer than the tables
            value = np.uint64(0)
            for b in range(0, len(chunk), _SPAN):
                part = chunk[b:b + _SPAN]
                value = _mix(np.array([value ^ np.sum(part * _UP[:len(part)], dtype=np.uint64)]))[0]
            hashes[i:j] = value
        else:
            sums = np.zeros(len(chunk) + 1, dtype=np.uint64)
            np.cumsum(chunk * _UP[:len(chunk)], out=sums[1:])
            a, z = starts[i:j] - base, ends[i:j] - base
            hashes[i:j] = _mix((sums[z] - sums[a]) * _DOWN[a])
        i = j
    return low, starts, ends, hashes


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, given the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * _BASE + words[i:n + i]
    return _mix(out)


def _minhash_keys(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64), odd


def build_index(items: list[tuple], shingle: int = SHINGLE, hashes: int = HASHES) -> dict:
    """Index of test items (id, text): their shingles and, by shingle length, the shingles
    that are an item's minimum under some hash function."""
    xor, odd = _minhash_keys(hashes)
    entries: dict[int, dict[int, list]] = {}
    kept = []
    for ident, text in items:
        low, starts, ends, words = word_hashes((text or "").encode())
        if not len(words):
            continue
        k = min(shingle, len(words))
        grams = shingle_hashes(words, k)
        raw = low.tobytes()
        tokens = [raw[a:z] for a, z in zip(starts, ends)]
        first: dict = {}
        for p in range(len(grams)):
            first.setdefault(tuple(tokens[p:p + k]), int(grams[p]))
        values = np.array(list(first.values()), dtype=np.uint64)
        number = len(kept)
        kept.append({"id": ident, "k": k, "grams": list(first.items()),
                     "u": 1 << len(first).bit_length()})
        for j in range(hashes):
            best = int(values[int(np.argmin(_mix((values ^ xor[j]) * odd[j])))])
            entries.setdefault(k, {}).setdefault(best, []).append((number, j))
    tables = {}
    for k, minima in entries.items():
        values = np.array(sorted(minima), dtype=np.uint64)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[(values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        tables[k] = (values, seen, [minima[int(v)] for v in values])
    return {"items": kept, "tables": tables, "xor": xor, "odd": odd}


def _candidates(index: dict, k: int, grams: np.ndarray) -> set[int]:
    """Items that share a minimum with a window of the document's shingles."""
    values, seen, owners = index["tables"][k]
    at = np.flatnonzero(seen[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    if not len(at):
        return set()
    slot = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
    real = values[slot] == grams[at]
    found: set[int] = set()
    tried: set = set()
    for p, s in zip(at[real].tolist(), slot[real].tolist()):
        for number, j in owners[s]:
            if number in found:
                continue
            u = index["items"][number]["u"]
            for window in (p // u - 1, p // u):
                if window < 0 or (number, j, window) in tried:
                    continue
                tried.add((number, j, window))
                part = _mix((grams[window * u:(window + 2) * u] ^ index["xor"][j]) * index["odd"][j])
                mine = _mix((grams[p:p + 1] ^ index["xor"][j]) * index["odd"][j])[0]
                if part.min() == mine:
                    found.add(number)
                    break
    return found


def search(index: dict, data: bytes, threshold: float = THRESHOLD) -> list[tuple]:
    """(item id, shingles found, shingles) of every item that the text contains."""
    if not index["items"] or not data:
        return []
    low, starts, ends, words = word_hashes(data)
    out = []
    raw = None
    for k in index["tables"]:
        grams = shingle_hashes(words, k)
        if not len(grams):
            continue
        for number in sorted(_candidates(index, k, grams)):
            item = index["items"][number]
            raw = low.tobytes() if raw is None else raw
            wanted = np.array([h for _, h in item["grams"]], dtype=np.uint64)
            spots = np.flatnonzero(np.isin(grams, wanted))
            places: dict[int, list[int]] = {}
            for p in spots.tolist():
                places.setdefault(int(grams[p]), []).append(p)
            found = 0
            for words_of, h in item["grams"]:
                found += any(all(raw[starts[p + i]:ends[p + i]] == words_of[i] for i in range(k))
                             for p in places.get(h, ()))
            if found / len(item["grams"]) >= threshold:
                out.append((item["id"], found, len(item["grams"])))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded text, each collected on its own."""
    ident, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    size = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    items = benchmark.select(ident.alias("id"), text.alias("text")).filter(text.isNotNull())
    if blocks == 1:
        yield [tuple(r) for r in items.orderBy("id", "text").collect()]
        return
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield [tuple(r) for r in part.orderBy("id", "text").collect()]


def _matcher(spark, items: list[tuple], threshold: float):
    shared = spark.sparkContext.broadcast(build_index(items))

    def match(arrays):
        rows = [search(shared.value, x, threshold) for x in byte_texts(arrays[0])]
        return [[[m[i] for m in r] for r in rows] for i in range(3)]

    return match


_FOUND = ("items", "found", "size")


def _matched(docs: DataFrame, text_col: str, items: list[tuple], threshold: float, prefix: str,
             keep: list[str] | None = None) -> DataFrame:
    kinds = (T.StringType(), T.LongType(), T.LongType())  # ids of any type, as text
    fields = [T.StructField(f"{prefix}{n}", T.ArrayType(k, True), False)
              for n, k in zip(_FOUND, kinds, strict=True)]
    return arrow_rows(docs, [text_col], _matcher(docs.sparkSession, items, threshold), fields, keep)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it contains: ``doc_id``, ``item_id``, ``n_found``,
    ``n_shingles``, ``containment``."""
    out, kind = None, benchmark.schema[item_id].dataType
    for items in _blocks(benchmark, item_id, item_text):
        hits = _matched(docs.select(f"`{id_col}`", f"`{text_col}`"), text_col, items, threshold,
                        "_w_", [id_col])
        rows = hits.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(F.arrays_zip(
            "_w_items", "_w_found", "_w_size")).alias("m")).select(
            "doc_id", F.col("m._w_items").cast(kind).alias("item_id"), F.col("m._w_found").alias("n_found"),
            F.col("m._w_size").alias("n_shingles"),
            (F.col("m._w_found") / F.col("m._w_size")).alias("containment"))
        out = rows if out is None else out.union(rows)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_id: str = "item_id", item_text: str = "text",
                        threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with the columns they had."""
    p = private(docs)
    out = docs
    for items in _blocks(benchmark, item_id, item_text):
        hits = _matched(out, text_col, items, threshold, p)
        out = hits.filter(F.size(f"{p}items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out
