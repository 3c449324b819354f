"""SimHash near-duplicates by bit-sliced comparison (operator 1).

Fingerprints.  A text is lower-cased (A-Z) and cut into words at ASCII white space; a bit of
its 64-bit fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of its
4-word shingles, repeats included.

Links.  Fingerprints link if at most ``RADIUS`` bits differ.  Equal fingerprints fall together
first, by an aggregate.  The 64 bits are cut into ``B > RADIUS`` blocks; two linked fingerprints
agree in ``B - RADIUS`` blocks at least, so every distinct fingerprint goes to one bucket for
each choice of that many blocks, and only buckets are compared, whole.  ``B`` is the smallest
for which evenly spread fingerprints make buckets of a quarter ``TILE`` or less (5 blocks and 5
buckets a fingerprint up to millions, 6 and 15 up to billions); any ``B`` gives the same links.  In a bucket the fingerprints stand bit-sliced:
plane ``b`` holds bit ``b`` of 64 fingerprints in one machine word.  One XOR a plane gives
the differences of a query to 64 fingerprints, carry-save counters (ones, twos, fours, and a
flag beyond) add them up, and a word all of whose counters exceed the radius is abandoned.

Large buckets.  A bucket beyond ``TILE`` fingerprints is cut into chunks and compared chunk
by chunk, each pair of chunks in its own group, so no task holds a whole bucket.  A group
gives the edges of a spanning forest of its links, not all links: components stay whole and
a group of thousands of near copies yields thousands of edges, not millions.

Components.  Large-star / small-star rounds on the edges, written to the shared stage folder
after each round; nothing of them reaches the driver but two sums.

Defined results: null or empty text has fingerprint 0; a null id never names a component
unless all its ids are null; repeated rows stay, each with the same component; an empty
table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import arrow_rows, byte_texts, materialize, private

SHINGLE = 4
RADIUS = 4
#: Most fingerprints of a bucket that are compared in one group.
TILE = 4096
#: Items (query, word of 64 fingerprints) that are compared at a time.
ITEMS = 1 << 18


# ------------------------------------------------------------------- fingerprints

def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text, unsigned."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    xxh = xxhash.xxh64_intdigest
    if n <= shingle:
        return xxh(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past each word's space
    starts = [0, *ends[:n - shingle]]
    counts = np.zeros(64, dtype=np.int64)
    total = n - shingle + 1
    for lo in range(0, total, 8192):
        hi = min(lo + 8192, total)
        hashes = np.array([xxh(joined[a:b - 1], 42)
                           for a, b in zip(starts[lo:hi], ends[lo + shingle - 1:hi + shingle - 1])],
                          dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = counts * 2 > total
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _batch_fingerprints(arrays):
    values = np.array([fingerprint(x) for x in byte_texts(arrays[0])], dtype=np.uint64)
    return [pa.array(values.view(np.int64))]


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp",
                     keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) and the fingerprint as a signed long."""
    return arrow_rows(docs, [text_col], _batch_fingerprints,
                      [T.StructField(name, T.LongType(), False)], keep)


# --------------------------------------------------------------- bit-sliced groups

def _planes(words: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints in words of 64: (n, 64) values become (64, n) words."""
    out = np.empty((64, len(words)), dtype=np.uint64)
    for b in range(64):
        bits = ((words >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius (counters: bit k of the count, by lane)."""
    greater, equal = np.zeros_like(over), ~np.zeros_like(over)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return over | greater


def near_lanes(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, valid: np.ndarray,
               radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For items (query value, word index): the items and lanes within the radius.

    ``valid`` masks the lanes in use of each word.  Items are dropped as soon as no lane of
    theirs is within the radius.
    """
    item = np.arange(len(queries))
    counters = [np.zeros(len(queries), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(queries), dtype=np.uint64)
    one = np.uint64(1)
    for b in range(64):
        carry = planes[b][word] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & one))
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b >= 2 * radius + 4 and b % 4 == 3 or b == 63:
            alive = ~_beyond(counters, over, radius) & valid[word]
            on = np.flatnonzero(alive)
            if len(on) < 0.7 * len(item) or b == 63:
                item, queries, word, over = item[on], queries[on], word[on], over[on]
                counters = [c[on] for c in counters]
                if b == 63:
                    alive = alive[on]
            if not len(item):
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return item[row], word[row] * 64 + lane


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; ``parent`` maps each member to its set's smallest."""
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        differ = low != high
        if not differ.any():
            return
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def group_edges(fps: np.ndarray, group: np.ndarray, second: np.ndarray,
                radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smaller member) of a spanning forest of the links in each group.

    Rows are sorted by (group, second); ``second`` marks the second chunk of a group of two
    chunks, which is compared with the first only.  The forest's edges name members of one
    group, each linked through links of at most ``radius`` bits.
    """
    n = len(fps)
    run = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1])
                                         | (second[1:] != second[:-1]))))
    sizes = np.diff(np.concatenate((run, [n])))
    words_of = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words_of)))
    chunk = np.repeat(np.arange(len(run)), sizes)
    slot = first_word[chunk] * 64 + np.arange(n) - run[chunk]
    flat = np.zeros(first_word[-1] * 64, dtype=np.uint64)
    flat[slot] = fps
    member = np.full(len(flat), -1, dtype=np.int64)
    member[slot] = np.arange(n)
    used = np.zeros(len(flat), dtype=np.uint8)
    used[slot] = 1
    valid = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = _planes(flat.reshape(-1, 64))
    # words that each member is compared with: those from its own on, or all of the other chunk
    two = np.zeros(len(run), dtype=bool)
    two[:-1] = (group[run[1:]] == group[run[:-1]]) if len(run) > 1 else two[:-1]
    from_word = np.where(two[chunk], first_word[np.minimum(chunk + 1, len(run))], slot // 64)
    to_word = np.where(two[chunk], first_word[np.minimum(chunk + 2, len(run))],
                       first_word[chunk + 1])
    to_word = np.where(second.astype(bool), from_word, to_word)
    todo = to_word - from_word
    upto = np.cumsum(todo)
    parent = np.arange(n)
    lo = 0
    while lo < n:
        done = upto[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(upto, done + ITEMS, side="right")), lo + 1)
        count = todo[lo:hi]
        q = np.repeat(np.arange(lo, hi), count)
        w = from_word[q] + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        if len(q):
            item, lane = near_lanes(planes, fps[q], w, valid, radius)
            _join(parent, q[item], member[lane])
        lo = hi
    child = np.flatnonzero(parent != np.arange(n))
    return fps[child], fps[parent[child]]


def block_count(distinct: int, radius: int = RADIUS, tile: int = TILE) -> int:
    """Fewest blocks whose buckets hold a quarter tile of evenly spread fingerprints."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct > tile / 4 * 2 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def bucket_keys(fp, radius: int, blocks: int) -> list:
    """One bucket key (a long) for each choice of ``blocks - radius`` blocks of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key, used = F.lit(number << 40).cast("long"), 0
        for b in chosen:
            bits = cuts[b + 1] - cuts[b]
            value = F.shiftrightunsigned(fp, cuts[b]).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key, used = key + F.shiftleft(value, used), used + bits
        keys.append(key)
    return keys


def _compare(radius: int):
    def flush(frames):
        import pandas as pd  # noqa: PLC0415 - in the task

        if not frames:
            return None
        t = pd.concat(frames) if len(frames) > 1 else frames[0]
        fps = t["fp"].to_numpy().view(np.uint64)
        key = t["bucket"].to_numpy()
        group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1])
                                          | (t["i"].to_numpy()[1:] != t["i"].to_numpy()[:-1])
                                          | (t["j"].to_numpy()[1:] != t["j"].to_numpy()[:-1]))))
        a, b = group_edges(np.ascontiguousarray(fps), group, t["second"].to_numpy(), radius)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            t = batch.to_pandas()
            if not len(t):
                continue
            held.append(t)
            rows += len(t)
            if rows < 1 << 17:
                continue
            # whole groups go now, the last one waits for its other rows
            import pandas as pd  # noqa: PLC0415

            t = pd.concat(held)
            end = t.iloc[-1]
            last = ((t["bucket"] == end["bucket"]) & (t["i"] == end["i"]) & (t["j"] == end["j"])).to_numpy()
            out = flush([t[~last]] if (~last).any() else [])
            if out is not None and out.num_rows:
                yield out
            held, rows = [t[last]], int(last.sum())
        out = flush(held)
        if out is not None and out.num_rows:
            yield out

    return run


def linked_edges(fps: DataFrame, radius: int = RADIUS, tile: int = TILE,
                 blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``fp`` linked within the radius."""
    blocks = blocks or block_count(fps.count(), radius, tile)
    keys = F.array(*bucket_keys(F.col("fp"), radius, blocks))
    keyed = fps.select("fp", F.explode(keys).alias("bucket"))
    chunks = F.ceil(F.col("n") / tile).cast("int")
    large = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile) \
        .select("bucket", chunks.alias("chunks"))
    dealt = keyed.join(large, "bucket", "left") \
        .withColumn("chunks", F.coalesce(F.col("chunks"), F.lit(1))) \
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = dealt.select("fp", "bucket", F.least("chunk", "other").alias("i"),
                         F.greatest("chunk", "other").alias("j"),
                         (F.col("chunk") > F.col("other")).cast("int").alias("second"))
    return tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "second") \
        .mapInArrow(_compare(radius), "a long, b long").distinct()


# -------------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star rounds; every round is written to the stage folder.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .filter("u <> v").distinct(), "cc")
    seen = None
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        current = materialize(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = current.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        roots.select(F.col("root").alias("node"), "root").distinct())


def fingerprint_components(marked: DataFrame, fp: str, ident: str, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the smallest id among all rows whose fingerprints are connected."""
    fps = materialize(marked.groupBy(F.col(f"`{fp}`").alias("fp"))
                      .agg(F.min(F.col(f"`{ident}`")).alias("least")), "simhash-fps")
    roots = components(linked_edges(fps.select("fp"), radius))
    rooted = fps.join(roots, fps.fp == roots.node, "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("fp", "component", "root")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    marked = materialize(with_fingerprint(docs.select(f"`{id_col}`", f"`{text_col}`"), text_col,
                                          "_fp", [id_col]), "simhash-docs")
    comp = fingerprint_components(marked, "_fp", id_col, radius)
    hexa = F.lower(F.lpad(F.hex(F.col("_fp")), 16, "0"))
    return marked.join(comp, F.col("_fp") == F.col("fp")).select(
        F.col(f"`{id_col}`"), hexa.alias("fingerprint"), F.col("component").alias("component_id"))


def row_keys(docs: DataFrame) -> list:
    """Two hashes of the whole row."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*every), F.xxhash64(F.lit(1), *every)]


def keep_first(docs: DataFrame, marked: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each root, with the columns of ``docs``: the one with the smallest id (null
    last), then with the smallest hash of the whole row.

    ``marked`` has a row (fp, id, a, b) for each row of ``docs``, with its keys; ``roots`` gives
    the root of each fp.
    """
    p = private(docs)
    ident, every, hashes = F.col(f"`{id_col}`"), [F.col(f"`{c}`") for c in docs.columns], row_keys(docs)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "a", "b")
    # rows that are repeated whole share all keys: n counts them; one row of each fp is joined,
    # so a fingerprint of many documents is no hot key
    least = marked.groupBy("fp", order.alias("o")).agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("fp").agg(F.min(F.struct("o", "n")).alias("least"))
    first = least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("first"))
    keep = materialize(first.select(*[F.col(f"first.o.{c}").alias(f"{p}{c}") for c in ("id", "a", "b")],
                                    F.col("first.n").alias(f"{p}n")), "simhash-kept")
    same = ident.eqNullSafe(F.col(f"{p}id")) & (hashes[0] == F.col(f"{p}a")) & (hashes[1] == F.col(f"{p}b"))
    kept = docs.join(keep, same)
    if keep.filter(F.col(f"{p}n") > 1).isEmpty():
        return kept.select(*every)
    several = kept.filter(F.col(f"{p}n") > 1).dropDuplicates([f"{p}a", f"{p}b"])
    return kept.filter(F.col(f"{p}n") == 1).union(several).select(*every)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the columns of ``docs``, as ``keep_first`` chooses it.

    Which row stays is found from ids, fingerprints and two hashes of the whole row alone; the
    texts are read once more and joined to those keys, so they are shuffled at most once and
    no group meets in one task.
    """
    hashes = row_keys(docs)
    keyed = docs.select(F.col(f"`{text_col}`"), F.col(f"`{id_col}`").alias("id"),
                        hashes[0].alias("a"), hashes[1].alias("b"))
    marked = materialize(with_fingerprint(keyed, text_col, "fp", ["id", "a", "b"]), "simhash-rows")
    comp = fingerprint_components(marked, "fp", "id", radius)
    return keep_first(docs, marked, comp.select("fp", "root"), id_col)
