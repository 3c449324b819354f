"""Secret scans by dictionary-primed zstandard novelty (operator 4).

Three fixed patterns find the secrets of known form.  Beyond them every string of
``CANDIDATE``'s form that contains a letter and a digit is a candidate, wherever it stands.
Its context is sensitive if a word such as ``key`` or ``auth`` stands in the ``AROUND``
characters before or after it, across line ends (a value below its key, a label after the
value); the lines of a key block (base64 lines one below the other) inherit the context of
the line above, so a block counts to its end.

A compressor primed with a dictionary of common identifiers compresses the surroundings with
and without the candidate; the bytes the candidate adds, over its length, are its novelty.
Names, versions and paths are made of pieces that the dictionary or the surrounding text holds
and cost little; a random string costs most of its entropy.  Candidates of ``NOVELTY`` bytes a
character or more in a sensitive context are reported as kind ``novel`` unless they overlap a
span of fixed form.

Texts are read in place, one at a time; nothing is shuffled.  The candidates of a text are
enumerated once and each one is judged by a window of fixed size, so the time is linear in the
text, whatever it holds.

Defined results: a null or empty text has no spans; every row is scanned on its own, rows
with equal ids too; an empty table gives an empty table; extra columns stay.  Offsets are
code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weekcast.llm.common import arrow_rows, private, str_texts

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]
NOVELTY = 0.65
LEAST = 16
AROUND = 160

# Fixed patterns: (password|passwd|secret|token|api_?key) assignments, AKIA access keys, hex.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                     r"([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so shorter ones are just the failing matches

_WORDS = (r"pass(?:word|wd|phrase|code)?s?", r"secrets?", r"tokens?", r"(?:api)?keys?", r"auth(?:entication|orization)?",
          r"cred(?:ential)?s?", r"bearer", r"private", r"signature", r"session")
#: A sensitive word of its own, or a capitalised one inside a name (accessKey).
_SENSITIVE = re.compile(r"(?<![A-Za-z])(?i:%s)(?![a-z])|(?:Pass(?:word|wd)?|Secret|Token|Key|Auth|Credential)s?(?![a-z])"
                        % "|".join(_WORDS))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What may stand between two lines of one key block.
_SAME_BLOCK = re.compile(r"(?:\\[nr]|[\s\"',+\\])+")

#: Identifiers and words of code and settings that prime the compressor.
IDENTIFIERS = """
public private protected static final class interface function return import export default
const let var string integer boolean double float object array list dict map null none true false
self this super async await yield lambda module package require include namespace struct
config settings options environment production development staging testing localhost hostname
username user_name user_id account_id client_id client_name project_id region_name bucket_name
database table column primary_key foreign_key index session_id request_id response_code status_code
created_at updated_at deleted_at timestamp version release revision branch commit merge build deploy
http https www com org net json yaml xml html css application/json text/plain content-type
authorization bearer authentication certificate private_key public_key access_key secret_key
api_key api_token access_token refresh_token password_hash encryption signature checksum
get_value set_value to_string from_string parse_args main_function test_case handler listener
service controller repository factory manager provider adapter middleware component container
docker kubernetes cluster server client proxy gateway endpoint connection timeout retry buffer
error warning info debug trace exception message example sample placeholder your-key-here changeme
application source main java python script document documents department finance policy security
report account customer order payment invoice product country city street language number name
first second last next previous current new old value values file files path folder image page
user users group team member manager admin system process thread memory network device event
string to_string or default cache from by with for and the is are on in of at method class test tests
january february march april may june july august september october november december
2015 2016 2017 2018 2019 2020 2021 2022 2023 2024 2025 2026
"""


def dictionary(words: str = IDENTIFIERS) -> bytes:
    """The words as they are, capitalised one after the other, and joined by ``_`` and ``-``."""
    each = words.split()
    camel = "".join(w.capitalize() for w in each)
    return "\n".join((camel, "-".join(each), "_".join(each), words)).encode()


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def _compressor() -> zstandard.ZstdCompressor:
    """Short matches count: an identifier is pieces of three characters and more."""
    primed = zstandard.ZstdCompressionDict(dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    search = zstandard.ZstdCompressionParameters.from_level(12, min_match=3, write_content_size=False)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=search)


def novelty(press: zstandard.ZstdCompressor, before: str, candidate: str, after: str) -> float:
    """Bytes that the candidate adds to its compressed surroundings, a character."""
    with_it = len(press.compress((before + candidate + after).encode()))
    return (with_it - len(press.compress((before + after).encode()))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start and then kind as listed."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append((m.start(), 1, m.end()))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return [(a, z, KINDS[k]) for a, k, z in sorted(found)]


def novel_spans(text: str, base: list[tuple[int, int, str]], press) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context whose novelty is high, apart from the base spans."""
    found, at = [], 0
    ends = sorted(base)
    last, sensitive = None, False  # the end of the previous candidate, and its context
    for c in CANDIDATE.finditer(text):
        lo, hi = c.span()
        block = last is not None and lo - last <= 16 and _SAME_BLOCK.fullmatch(text, last, lo) is not None
        sensitive = block and sensitive
        last = hi
        value = c.group()
        if not (_DIGIT.search(value) and _LETTER.search(value)):
            continue
        before, after = text[max(0, lo - AROUND):lo], text[hi:hi + AROUND]
        sensitive = sensitive or _SENSITIVE.search(before) is not None or _SENSITIVE.search(after) is not None
        if not sensitive:
            continue
        while at < len(ends) and ends[at][1] <= lo:
            at += 1
        k = at
        while k < len(ends) and ends[k][0] < hi and ends[k][1] <= lo:
            k += 1
        if k < len(ends) and ends[k][0] < hi:
            continue
        if novelty(press, before, value, after) >= NOVELTY:
            found.append((lo, hi, "novel"))
    return found


def scan(text: str | None, press) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + novel_spans(text, base, press), key=lambda s: (s[0], order[s[2]]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def _batch(arrays):
    press = _compressor()
    out = [[] for _ in range(5)]
    for text in str_texts(arrays[0]):
        base, spans = scan(text, press)
        for i, kind in enumerate(BASE_KINDS):
            out[i].append(sum(s[2] == kind for s in base))
        out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out[4].append(joined(spans))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", prefix: str | None = None) -> DataFrame:
    """``docs`` and, under ``prefix``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and
    ``spans`` (``kind:start:end`` by start, comma-joined; kind ``novel`` is the method's)."""
    p = private(docs) if prefix is None else prefix
    fields = [T.StructField(f"{p}n_{k}", T.LongType(), False) for k in BASE_KINDS]
    fields += [T.StructField(f"{p}{n}", T.StringType(), False) for n in ("base_sha256", "spans")]
    return arrow_rows(docs, [text_col], _batch, fields)
