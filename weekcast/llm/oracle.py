"""DuckDB SQL of the queries of this subpackage that SQL can express.

``op1``, ``op2``, ``op8`` and ``op9`` (XXH64, a neural labeller, a trained classifier, boosted
trees) and the method's own spans of ``op4`` and labels of ``op6`` are beyond SQL; the tests
hold those against brute force or held-out accuracy.
"""

from __future__ import annotations

from weekcast.llm import line_runs, mixing, quality

_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _line_dedup(min_words: int = line_runs.MIN_WORDS) -> str:
    return f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, len(regexp_extract_all(line, {_WORD})) AS words FROM line),
seq AS (
  SELECT doc_id, pos, line, words, row_number() OVER w AS idx, sum(words) OVER w AS upto
  FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
doc AS (SELECT doc_id, list(line ORDER BY idx) AS lines, list(pos ORDER BY idx) AS places,
               list(upto ORDER BY idx) AS sums FROM seq GROUP BY doc_id),
site AS (
  SELECT s.doc_id, s.idx,
         len(list_filter(d.sums, lambda x: x < s.upto - s.words + {min_words})) + 1 AS last
  FROM seq s JOIN doc d USING (doc_id)),
piece AS (
  SELECT s.doc_id, s.idx, array_to_string(d.lines[s.idx:s.last], chr(10)) AS body
  FROM site s JOIN doc d USING (doc_id) WHERE s.last <= len(d.lines)),
-- every earlier place of the same piece: the copy goes as far as any of them agrees
tail AS (
  SELECT c.doc_id, c.idx, d.lines[c.idx:] AS a, e.lines[p.idx:] AS b
  FROM piece c JOIN piece p ON p.body = c.body AND (p.doc_id, p.idx) < (c.doc_id, c.idx)
  JOIN doc d ON d.doc_id = c.doc_id JOIN doc e ON e.doc_id = p.doc_id),
reach AS (
  SELECT doc_id, idx, max(least(len(a), len(b), coalesce(list_position(
    list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1,
    1000000000))) AS n FROM tail GROUP BY doc_id, idx),
gone AS (SELECT DISTINCT doc_id, unnest(range(idx, idx + n)) AS idx FROM reach),
spot AS (SELECT g.doc_id, g.idx, d.places[g.idx] AS lo,
                CASE WHEN n.idx IS NULL THEN d.places[g.idx] ELSE d.places[g.idx + 1] - 1 END AS hi
         FROM gone g JOIN doc d USING (doc_id)
         LEFT JOIN gone n ON n.doc_id = g.doc_id AND n.idx = g.idx + 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM spot),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM line l ANTI JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(r.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)"""


def _decontamination() -> str:
    def grams(table: str, ident: str) -> str:
        return f"""
  SELECT {ident}, unnest(list_transform(range(1, len(words) - 3), lambda i:
         array_to_string(words[i:i + 4], ' '))) AS gram
  FROM (SELECT {ident}, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_ALNUM}) AS words
        FROM {table} WHERE text IS NOT NULL) WHERE len(words) >= 5"""
    return f"""
WITH item AS (SELECT DISTINCT item_id, gram FROM ({grams('benchmark', 'item_id')})),
size AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id),
doc AS (SELECT DISTINCT doc_id, gram FROM ({grams('documents', 'doc_id')})),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc JOIN item USING (gram)
        GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_found, n_shingles, n_found::DOUBLE / n_shingles AS containment
FROM hit JOIN size USING (item_id) WHERE n_found::DOUBLE / n_shingles >= 0.8"""


def _mixing(passes: int = mixing.PASSES) -> str:
    steps = ""
    taken = "false"
    for k in range(passes):
        now = f"(d.size <= s{k}.rest AND d.t <= coalesce(c{k}.cut, 0.0))"
        before = " ".join(f"LEFT JOIN cut{j} c{j} ON c{j}.src = d.src JOIN state{j} s{j} ON s{j}.src = d.src"
                          for j in range(k))
        steps += f""",
row{k} AS (SELECT d.src, d.size, d.t, s{k}.rest, sum(d.size) OVER (PARTITION BY d.src ORDER BY d.t) AS cum
  FROM rated d JOIN state{k} s{k} ON s{k}.src = d.src {before}
  WHERE d.t IS NOT NULL AND d.size <= s{k}.rest AND NOT ({taken})),
cut{k} AS (SELECT src, max(t) AS cut, max(cum) AS used FROM row{k} WHERE cum <= rest GROUP BY src),
state{k + 1} AS (SELECT s.src, s.rest - coalesce(c.used, 0) AS rest
  FROM state{k} s LEFT JOIN cut{k} c USING (src))"""
        taken = f"{taken} OR {now}"
    joins = " ".join(f"LEFT JOIN cut{j} c{j} ON c{j}.src = d.src JOIN state{j} s{j} ON s{j}.src = d.src"
                     for j in range(passes))
    steps += f""",
near AS (SELECT d.src, min({{'gap': abs(d.size - z.rest), 't': d.t, 'size': d.size}}) AS n
  FROM rated d JOIN state{passes} z ON z.src = d.src {joins}
  WHERE d.t IS NOT NULL AND d.size < 2 * z.rest AND NOT ({taken}) GROUP BY d.src)"""
    joins += " LEFT JOIN near ON near.src = d.src"
    taken += " OR coalesce(near.n.t = d.t AND near.n.size = d.size, false)"
    key = "coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, '')"
    return f"""
WITH sized AS (
  SELECT doc_id, source, (source IS NULL, coalesce(source, '')) AS src,
    coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
    (('0x' || substr(md5(md5({key}) || ':' || (row_number() OVER (PARTITION BY {key}) - 1) || ':mix'), 1, 13))
      ::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
source AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w
             FROM source),
ordered AS (
  SELECT *, sum(source_size * 3) OVER o AS full_words, sum(w) OVER o AS full_w,
         sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM weighted WINDOW o AS (ORDER BY source_size * 3.0 / w, src)),
-- with the first sources cut at their limit, the factor that shares out the rest
factor AS (
  SELECT total - coalesce(lag(full_words) OVER o, 0) AS words,
         all_w - coalesce(lag(full_w) OVER o, 0) AS ws, w, source_size
  FROM ordered WINDOW o AS (ORDER BY source_size * 3.0 / w, src)),
chosen AS (SELECT min_by(words, -ws) AS words, max(ws) AS ws FROM factor
           WHERE w * words <= 3 * source_size * ws),
target AS (
  SELECT src, source_size, CASE WHEN w * c.words > 3 * source_size * c.ws
    THEN (3 * source_size)::DOUBLE ELSE w::DOUBLE * c.words::DOUBLE / c.ws::DOUBLE END AS target
  FROM weighted, chosen c),
-- within a source, copies by the binary digits of the size
class AS (SELECT src, length(bin(size)) AS k, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY 1, 2),
tried AS (
  SELECT c.*, t.target, (t.target - 3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(k * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
  FROM class c JOIN target t USING (src) WINDOW o AS (PARTITION BY c.src ORDER BY k DESC)),
fits AS (SELECT src, max_by(f, k) AS f FROM tried WHERE f * k <= 3 GROUP BY src),
rate AS (
  SELECT src, k, words, floor(r)::BIGINT AS whole, r - floor(r) AS p FROM (
    SELECT c.*, greatest(least(coalesce(f * k, 3.0), 3.0), 0.0)::DOUBLE AS r
    FROM class c LEFT JOIN fits USING (src)) x),
rated AS (
  SELECT d.*, r.whole, CASE WHEN r.p > 0 THEN (u * (1 - r.p)) / (u * (1 - r.p) + (1 - u) * r.p) END AS t
  FROM sized d LEFT JOIN rate r ON r.src = d.src AND r.k = length(bin(d.size))),
state0 AS (SELECT t.src, greatest(t.target - coalesce(x.certain, 0), 0.0) AS rest FROM target t
  LEFT JOIN (SELECT src, sum(whole * words)::BIGINT AS certain FROM rate GROUP BY src) x USING (src)){steps}
SELECT d.doc_id, d.size, t.source_size, t.target,
  CASE WHEN d.size > 0 THEN ((d.whole + CASE WHEN d.t IS NOT NULL AND ({taken}) THEN 1 ELSE 0 END) * d.size)::BIGINT
       ELSE 0 END AS taken
FROM rated d JOIN target t ON t.src = d.src {joins}"""


def _quality() -> str:
    rules = list(quality.RULES)
    fails = ", ".join(f"({quality.RULES[r].format(**{s: s for s in quality.STATS})}) AS fail_{r}" for r in rules)
    # method of moments over the hosts, as in quality._prior
    prior = ", ".join(f"""sum(k_{r})::DOUBLE / sum(n) AS m_{r},
    sum(k_{r}::DOUBLE * k_{r} / n) AS kk_{r}""" for r in rules)
    spread = ", ".join(f"""(kk_{r} - tn * m_{r} * m_{r} - (h - 1) * m_{r} * (1 - m_{r}))
      / greatest(tn - nn / tn, 1.0) AS spread_{r}""" for r in rules)
    strength = ", ".join(f"""least(greatest(CASE WHEN spread_{r} > 1e-9
      THEN m_{r} * (1 - m_{r}) / spread_{r} - 1 ELSE 1e4 END, 2.0), 1e4) AS s_{r}""" for r in rules)
    guilty = ", ".join(f"""(k_{r} + greatest(m_{r}, 1e-6) * s_{r})
      / (n + greatest(m_{r}, 1e-6) * s_{r} + greatest(1 - m_{r}, 1e-6) * s_{r}) > {quality.HOST_RATE} AS g_{r}"""
                       for r in rules)
    by_host = " OR ".join(f"(fail_{r} AND g_{r})" for r in rules)
    return f"""
WITH word AS (
  SELECT rowid AS row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (
    SELECT rowid, regexp_extract_all(text, {_WORD}) AS words
    FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, text FROM documents))),
windows AS (SELECT row, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word
            WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY row, w, w2, w3) > 1 AS t FROM windows),
covered AS (SELECT row, t OR coalesce(lag(t, 1) OVER o, false) OR coalesce(lag(t, 2) OVER o, false) AS c
            FROM twice WINDOW o AS (PARTITION BY row ORDER BY i)),
repeats AS (SELECT row, count(*) FILTER (c) AS n FROM covered GROUP BY row),
line AS (SELECT rowid AS row, unnest(string_split(text, chr(10))) AS line
         FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, text FROM documents)),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM line
        WHERE regexp_matches(line, {_WORD}) GROUP BY row),
doc AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS n_words,
    coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
    coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rowid, * FROM documents) d
  LEFT JOIN repeats r ON r.row = d.rowid LEFT JOIN dup u ON u.row = d.rowid),
judged AS (SELECT *, {fails} FROM doc),
host AS (SELECT source, count(*) AS n, {', '.join(f"count(*) FILTER (fail_{r}) AS k_{r}" for r in rules)}
         FROM judged GROUP BY source),
prior AS (SELECT count(*) AS h, sum(n)::DOUBLE AS tn, sum(n::DOUBLE * n) AS nn, {prior} FROM host),
spread AS (SELECT *, {spread} FROM prior),
strength AS (SELECT *, {strength} FROM spread),
guilt AS (SELECT source, {guilty} FROM host, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_short OR fail_repeats) AS base_failed,
  NOT (fail_short OR fail_repeats) AND NOT ({by_host}) AS kept, ({by_host}) AS host_guilty
FROM judged j JOIN guilt g ON g.source IS NOT DISTINCT FROM j.source"""


def _exact_dedup() -> str:
    return """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def _merkle(heights: int = 5) -> str:
    """Trees of up to ``16 ** heights`` leaves a source, and as many sources."""
    def leaf(text: str) -> str:
        parts = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
                            for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({parts})"

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: list_reduce(
          list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i:
          CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

    def tree(name: str) -> str:
        out = ""
        for h in range(heights):
            out += f""",
{name}s{h} AS (SELECT *, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}{h} WHERE n > 1 WINDOW w AS (PARTITION BY g, p // 16 ORDER BY p)),
{name}{h + 1} AS (SELECT g, p // 16 AS p, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY p)) AS d
  FROM {name}{h} WHERE n > 1 GROUP BY g, p // 16, n)"""
        ends = " UNION ALL ".join(f"SELECT g, d FROM {name}{h} WHERE n = 1" for h in range(heights + 1))
        return out + f""",
{name}end AS ({ends})"""

    def folded(name: str, src: str, g: str, p: str, out: str) -> str:
        """One CTE a height: the running digest of each row."""
        text, at = "", src
        for h in range(heights):
            text += f""",
{out}{h} AS (SELECT r.* EXCLUDE (acc, sibs), coalesce(sha256(t.lft || r.acc || t.rgt), r.acc) AS acc,
    r.sibs || coalesce(t.lft || t.rgt, '') AS sibs
  FROM {at} r LEFT JOIN {name}s{h} t ON t.g = {g} AND t.p = {p} // {16 ** h})"""
            at = f"{out}{h}"
        return text

    return f"""
WITH doc AS (SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN ({crc}) % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")}
         ELSE {leaf('text')} END AS given FROM documents),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY g) AS n FROM ranked),
a0 AS (SELECT g, p, n, leaf AS d FROM placed){tree('a')},
b0 AS (SELECT 0 AS g, g AS p, count(*) OVER () AS n, d FROM aend){tree('b')},
start AS (SELECT doc_id, leaf, g, p, given AS acc, '' AS sibs FROM placed){folded('a', 'start', 'r.g', 'r.p', 'low')}{folded('b', f'low{heights - 1}', '0', 'r.g', 'up')}
SELECT u.doc_id, u.leaf, s.d AS subroot, r.d AS root, sha256(u.sibs) AS proof_sha256, u.acc AS folded_root,
       u.acc = r.d AS verified
FROM up{heights - 1} u JOIN aend s ON s.g = u.g CROSS JOIN bend r"""


def _filter_audit() -> str:
    letters = "ABCDE"
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    apart = " AND ".join(f"{x}.l <> {y}.l" for i, x in enumerate("vwxyz") for y in "vwxyz"[:i])
    return f"""
WITH word AS (SELECT doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
flag AS (SELECT coalesce(d.lang, '') AS part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m,
    coalesce(b.good, 0) AS good, coalesce(b.toxic, 0) AS toxic
  FROM word d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) b USING (doc_id)),
mask AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY part, m),
letter(l, bit) AS (VALUES {values}),
perm AS (SELECT v.l || w.l || x.l || y.l || z.l AS o, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letter v, letter w, letter x, letter y, letter z WHERE {apart}),
step AS (SELECT o, s, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS before
  FROM perm, range(1, 6) t(s)),
found AS (
  SELECT part, o, s, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN m & before > 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM mask, step GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, s::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found"""


ORACLE: dict[str, str] = {
    "op3_line_dedup": _line_dedup(),
    "op5_decontamination": _decontamination(),
    "op7_mixing": _mixing(),
    "op10_host_quality": _quality(),
    "op11_exact_dedup": _exact_dedup(),
    "op12_merkle_manifest": _merkle(),
    "op13_filter_audit": _filter_audit(),
}
