"""The registered queries again as plain SQL over the given tables, written token by token."""

from __future__ import annotations

from foretoken.plans.queries import SLICES, SMALL, WIDE_SEQ_LEN

PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\f\x0B\p{L}\p{N}]+|[ \t\n\r\f\x0B]+"
LENGTH = SMALL.row_length
SHARDS = SMALL.n_shards
CHUNKS = SMALL.id_chunks
BATCH = SMALL.batch_size
SCAN_BATCH = SMALL.scan_batch_size
AROUND = SMALL.context_ids
MU = SMALL.backoff
# Ids of a long context of the wide scan.
WIDE = WIDE_SEQ_LEN + 1
KEEP = SMALL.vocab_size - 258


def _source(table: str) -> str:
    if table == "conversations":
        return f"""
docs AS MATERIALIZED (
  SELECT CAST(conv_id AS BIGINT) * 1048576 + turn AS doc_id,
         CAST(conv_id % {SHARDS} AS INTEGER) AS shard, text, 'none' AS lang
  FROM conversations)"""
    return f"""
docs AS MATERIALIZED (
  SELECT doc_id, CAST(doc_id % {SHARDS} AS INTEGER) AS shard, text, lang FROM documents)"""


TOK = f""",
tok AS MATERIALIZED (
  SELECT doc_id, shard, lang, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT *, regexp_extract_all(text, '{PATTERN}') AS t FROM docs))"""

VOCAB = f""",
vocab AS MATERIALIZED (
  SELECT 0 AS id, '<|endoftext|>' AS token UNION ALL SELECT 1, '<unk>' UNION ALL
  SELECT CAST(b + 2 AS INTEGER), printf('<0x%02X>', b) FROM range(256) bytes(b) UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY c DESC, token) + 257 AS INTEGER), token
  FROM (SELECT token, count(*) AS c FROM tok WHERE strlen(token) <= 64
        GROUP BY token ORDER BY c DESC, token LIMIT {KEEP}))"""

# A token outside the table is spelled in bytes: two hex digits each.
ENC = """,
words AS (SELECT id, token FROM vocab WHERE id >= 258),
spelled AS (
  SELECT doc_id, shard, lang, pos, 0 AS sub, v.id FROM tok JOIN words v USING (token)
  UNION ALL
  SELECT doc_id, shard, lang, pos, sub, CAST(concat('0x', h[2 * sub + 1 : 2 * sub + 2]) AS INTEGER) + 2
  FROM (SELECT t.*, hex(encode(token)) AS h, unnest(range(strlen(token))) AS sub
        FROM tok t ANTI JOIN words USING (token))),
inner_ids AS (
  SELECT doc_id, shard, lang, id,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS pos FROM spelled),
lens AS MATERIALIZED (
  SELECT d.doc_id, d.shard, d.lang, CAST(coalesce(c, 0) + 2 AS INTEGER) AS n FROM docs d
  LEFT JOIN (SELECT doc_id, count(*) AS c FROM inner_ids GROUP BY doc_id) USING (doc_id)),
enc AS MATERIALIZED (
  SELECT doc_id, shard, lang, pos, id FROM inner_ids
  UNION ALL SELECT doc_id, shard, lang, 0, 0 FROM docs
  UNION ALL SELECT doc_id, shard, lang, n - 1, 0 FROM lens)"""

# One line per token of each full row.
CELLS = f""",
placed AS (
  SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY doc_id, pos) - 1 AS g,
         count(*) OVER (PARTITION BY shard) AS total FROM enc),
cells AS MATERIALIZED (
  SELECT shard, g // {LENGTH} AS sample, CAST(g % {LENGTH} AS INTEGER) AS cell, id
  FROM placed WHERE g // {LENGTH} < total // {LENGTH})"""

ROWS = """,
rows AS MATERIALIZED (
  SELECT shard, sample, string_agg(id, ' ' ORDER BY cell) AS tokens FROM cells
  GROUP BY shard, sample)"""

NOWRAP = f""",
ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) AS k FROM lens),
walk AS (
  WITH RECURSIVE w AS (
    SELECT shard, doc_id, k, n, CAST(0 AS BIGINT) AS sample, 0 AS fill FROM ordered WHERE k = 1
    UNION ALL
    SELECT o.shard, o.doc_id, o.k, o.n,
           w.sample + CASE WHEN w.fill + w.n >= {LENGTH} THEN 1 ELSE 0 END,
           CASE WHEN w.fill + w.n >= {LENGTH} THEN 0 ELSE w.fill + w.n END
    FROM w JOIN ordered o ON o.shard = w.shard AND o.k = w.k + 1)
  SELECT * FROM w),
kept AS (
  SELECT w.shard, w.sample, w.fill + e.pos AS cell, e.id
  FROM walk w JOIN enc e ON e.doc_id = w.doc_id AND w.fill + e.pos < {LENGTH})"""


def _base(table: str = "documents") -> str:
    return "WITH " + _source(table) + TOK + VOCAB + ENC


def _samples(table: str = "documents") -> str:
    return _base(table) + CELLS


def _ids(n: int) -> str:
    return ", ".join(f"id{k}" for k in range(n))


def _runs(n: int, source: str = "cells", keys: str = "shard, sample", at: str = "cell") -> str:
    """Runs of n neighbouring ids, by looking ahead inside each row."""
    ahead = "".join(
        f", lead(id, {k}) OVER (PARTITION BY {keys} ORDER BY {at}) AS id{k}" for k in range(1, n)
    )
    last = f"WHERE id{n - 1} IS NOT NULL" if n > 1 else ""
    return f"SELECT * FROM (SELECT *, id AS id0{ahead} FROM {source}) {last}"


def _grams(n: int, name: str = "grams") -> str:
    return f""",
{name} AS MATERIALIZED (
  SELECT {_ids(n)}, count(*) AS count FROM ({_runs(n)}) GROUP BY {_ids(n)})"""


def _prefixes(n: int, source: str = "grams", name: str = "prefixes") -> str:
    last = f"id{n - 1}"
    return f""",
{name} AS MATERIALIZED (
  SELECT {_ids(n - 1)}, arg_max({last}, row(count, -{last})) AS {last},
         CAST(sum(count) AS BIGINT) AS sum_count, max(count) AS max_count,
         max(count) / sum(count) AS frac_max
  FROM {source} GROUP BY {_ids(n - 1)})"""


def _top(n: int) -> str:
    limit = "" if n == 2 else f" AND sum_count > {SMALL.min_trigram_count}"
    names = ", ".join(f"v{k}.token AS token{k}" for k in range(n))
    joins = " ".join(f"JOIN vocab v{k} ON v{k}.id = p.id{k}" for k in range(n))
    text = " || ".join(f"v{k}.token" for k in range(n))
    return f""",
top AS MATERIALIZED (
  SELECT p.*, {names}, {text} AS seq FROM prefixes p {joins}
  WHERE frac_max > {SMALL.min_fraction}{limit})"""


def _six(value: str) -> str:
    return f"floor(({value}) * 1e6 + 0.5) / 1e6"


def _score(n: int) -> str:
    prefix = [f"id{k}" for k in range(n - 1)]
    on = " AND ".join(f"r.{c} = t.{c}" for c in prefix)
    shares = ", ".join(
        f"coalesce(avg(CASE WHEN lang = '{s}' THEN hit END), 0.0) AS p_{s}" for s in SLICES
    )
    rounded = ", ".join(_six(f"coalesce(p_{s}, 0.0)") + f" AS p_{s}" for s in SLICES)
    tokens = ", ".join(f"token{k}" for k in range(n))
    return (
        _samples()
        + _grams(n)
        + _prefixes(n)
        + _top(n)
        + f""",
runs AS ({_runs(n, "enc", "doc_id", "pos")}),
scores AS (
  SELECT {", ".join(f"t.{c}" for c in prefix)}, {shares}
  FROM (SELECT {", ".join(f"t.{c}" for c in prefix)}, r.lang,
               CASE WHEN r.id{n - 1} = t.id{n - 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
        FROM runs r JOIN top t ON {on}) t
  GROUP BY {", ".join(f"t.{c}" for c in prefix)})
SELECT {_ids(n)}, sum_count, max_count, {_six("frac_max")} AS frac_max, {tokens}, seq, {rounded}
FROM top LEFT JOIN scores USING ({", ".join(prefix)})"""
    )


def _scored(n: int) -> str:
    order = f"sum_count DESC, {_ids(n)}"
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({_score(n)})"


def _scan_base(n: int = 2) -> str:
    """Counts after long contexts of ``n`` ids and short ones without the first."""
    long, short = _ids(n), ", ".join(f"id{k}" for k in range(1, n))
    shifted = ", ".join(f"id{k} AS id{k + 1}" for k in range(n))
    return (
        _samples()
        + _grams(n, "bi")
        + _grams(n + 1, "tri")
        + f""",
short AS MATERIALIZED (
  SELECT *, count / sum(count) OVER (PARTITION BY {short}) AS p_short
  FROM (SELECT {shifted}, count FROM bi)),
ctx AS MATERIALIZED (SELECT {long}, CAST(sum(count) AS BIGINT) AS n FROM tri GROUP BY {long})"""
    )


def _metrics(n: int = 2) -> str:
    """Sums over the tokens seen after a long context; those only its short context knows all keep
    the same share r = mu / (n + mu) of their probability, so theirs are closed forms, and the
    likeliest of them is among the first n_seen + 1 tokens of the short context."""
    long, last = _ids(n), f"id{n}"
    short = ", ".join(f"id{k}" for k in range(1, n))
    ours = ", ".join(f"m.id{k}" for k in range(n))
    on_short = " AND ".join(f"r.id{k} = m.id{k}" for k in range(1, n))
    on_long = " AND ".join(f"t.id{k} = m.id{k}" for k in range(n))
    on_unseen = " AND ".join(f"u.id{k} = m.id{k}" for k in range(n))
    return f""",
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {short} ORDER BY p_short DESC, {last}) AS place FROM short),
seen AS MATERIALIZED (
  SELECT {", ".join(f"t.id{k}" for k in range(n + 1))}, c.n, s.p_short AS ps,
         (t.count + {MU} * s.p_short) / (c.n + {MU}) AS pl
  FROM tri t JOIN ctx c USING ({long}) JOIN short s USING ({short}, {last})),
sums AS MATERIALIZED (
  SELECT {long}, any_value(n) AS n, count(*) AS n_seen, sum(ps) AS mass, max(pl) AS best,
         arg_max({last}, row(pl, -{last})) AS best_id, max(abs(ps - pl)) AS delta,
         sum((ps - pl) * (ln(ps) - ln(pl))) / 2 AS js, max(ln(pl) - ln(ps)) AS excite,
         max(ln(ps) - ln(pl)) AS inhibit
  FROM seen GROUP BY {long}),
unseen AS (
  SELECT {ours}, arg_min(r.{last}, r.place) AS other, max(r.p_short) AS ps
  FROM sums m JOIN ranked r ON {on_short} AND r.place <= m.n_seen + 1
  LEFT JOIN tri t ON {on_long} AND t.{last} = r.{last}
  WHERE t.{last} IS NULL GROUP BY {ours}),
metrics AS MATERIALIZED (
  SELECT {ours}, n AS n_context, r.p_short,
         greatest(best, coalesce({MU} * u.ps / (n + {MU}), 0)) AS p_long,
         js + CASE WHEN u.ps IS NULL THEN 0 ELSE
           (1 - mass) * (1 - {MU} / (n + {MU})) * -ln({MU} / (n + {MU})) / 2 END AS js,
         greatest(delta, coalesce((1 - {MU} / (n + {MU})) * u.ps, 0)) AS p_delta_max,
         excite AS logit_excite_max,
         CASE WHEN u.ps IS NULL THEN inhibit ELSE -ln({MU} / (n + {MU})) END AS logit_inhibit_max,
         r.{last} AS short_max_id,
         CASE WHEN {MU} * u.ps / (n + {MU}) > best
                OR {MU} * u.ps / (n + {MU}) = best AND u.other < best_id
              THEN u.other ELSE best_id END AS long_max_id
  FROM sums m JOIN ranked r ON {on_short} AND r.place = 1
  LEFT JOIN unseen u ON {on_unseen})"""


VALUES = [
    "p_short",
    "p_long",
    "js",
    "p_delta_max",
    "logit_excite_max",
    "logit_inhibit_max",
]
_VALUES = ", ".join(f"{_six(v)} AS {v}" for v in VALUES)


def _metric_rows(n: int = 2) -> str:
    return f"\nSELECT {_ids(n)}, n_context, {_VALUES}, short_max_id, long_max_id FROM metrics"


_HIT = "p_long > 0.5 AND js > 0.5"

def _spelled(source: str, keys: str, name: str) -> str:
    """``name``: the text of each group of ``source (keys, cell, id)``.

    Bytes from one leading byte to the next are a character, if the group holds all of it.
    """
    return f""",
{name}_bytes AS (
  SELECT *, id - 2 AS b, (id - 2) & 192 <> 128 AS leads,
         cell - row_number() OVER (PARTITION BY {keys} ORDER BY cell) AS run
  FROM {source} WHERE id BETWEEN 2 AND 257),
{name}_grouped AS (
  SELECT *, count(*) FILTER (leads) OVER (PARTITION BY {keys}, run ORDER BY cell) AS nth
  FROM {name}_bytes),
{name}_characters AS (
  SELECT {keys}, min(cell) AS cell,
         CASE WHEN bool_or(leads) AND count(*) = CASE WHEN min_by(b, cell) < 128 THEN 1
                WHEN min_by(b, cell) < 224 THEN 2 WHEN min_by(b, cell) < 240 THEN 3 ELSE 4 END
              THEN decode(unhex(string_agg(printf('%02X', b), '' ORDER BY cell)))
              ELSE string_agg(printf('<0x%02X>', b), '' ORDER BY cell) END AS piece
  FROM {name}_grouped GROUP BY {keys}, run, nth),
{name} AS (
  SELECT {keys}, string_agg(piece, '' ORDER BY cell) AS text
  FROM (SELECT * FROM {name}_characters UNION ALL
        SELECT {keys}, cell, token FROM {source} JOIN vocab USING (id)
        WHERE id NOT BETWEEN 2 AND 257)
  GROUP BY {keys})"""


def _examples(n: int) -> str:
    """Places of hits after contexts of ``n`` ids, with their text and surroundings."""
    ids = [f"id{k}" for k in range(n)]
    tokens = " || ".join(f"v{k}.token" for k in range(1, n))
    joins = " ".join(f"JOIN vocab v{k} ON v{k}.id = f.id{k}" for k in range(n))
    return f""",
hits AS (SELECT * FROM metrics WHERE {_HIT}),
spots AS MATERIALIZED (
  SELECT shard, sample, cell AS spot, {_ids(n)} FROM ({_runs(n)})),
found AS MATERIALIZED (
  SELECT s.*, h.* EXCLUDE ({_ids(n)}) FROM spots s JOIN hits h USING ({_ids(n)})),
near AS MATERIALIZED (
  SELECT f.shard, f.sample, f.spot, c.cell, c.id FROM found f
  JOIN cells c ON c.shard = f.shard AND c.sample = f.sample
   AND c.cell BETWEEN f.spot + 1 - {AROUND} AND f.spot + {n - 1 + AROUND}),
around AS (
  SELECT shard, sample, spot, string_agg(id, ' ' ORDER BY cell) AS context_ids
  FROM near GROUP BY shard, sample, spot){_spelled("near", "shard, sample, spot", "contexts")},
examples AS MATERIALIZED (
  SELECT '[' || v0.token || ']' || {tokens} AS text, vs.token AS token_short,
         vl.token AS token_long, p_short, p_long, js,
         {" || ' ' || ".join(f"f.{c}" for c in ids)} AS long_ids,
         short_max_id, long_max_id, c.text AS context, context_ids, p_delta_max, logit_excite_max,
         logit_inhibit_max, f.shard, f.sample // {SCAN_BATCH} AS batch,
         f.sample % {SCAN_BATCH} AS sample, f.spot + 1 AS start
  FROM found f
  JOIN around a ON a.shard = f.shard AND a.sample = f.sample AND a.spot = f.spot
  JOIN contexts c ON c.shard = f.shard AND c.sample = f.sample AND c.spot = f.spot
  {joins}
  JOIN vocab vs ON vs.id = short_max_id JOIN vocab vl ON vl.id = long_max_id)"""


FIRSTS = """,
firsts AS (
  SELECT * FROM examples
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY shard, batch, sample, start) = 1)"""
_EXAMPLE_ROWS = "SELECT * REPLACE (" + _VALUES + ") FROM "


def _ranked(n: int) -> str:
    ids = _ids(n - 1)
    return _samples() + _grams(n) + _prefixes(n) + f"""
SELECT CAST(id0 % {CHUNKS} AS INTEGER) AS id0_chunk, {ids},
       row_number() OVER (PARTITION BY id0 % {CHUNKS} ORDER BY frac_max DESC, {ids}) AS rank
FROM prefixes"""


def _exported(n: int) -> str:
    """Counts of the tables of one width, each from its own statement."""
    base = _samples() + _grams(n) + _prefixes(n) + _top(n)
    return " UNION ALL ".join(
        f"SELECT * FROM ({base} SELECT '{name}_{n}' AS name, count(*) AS n_rows,"
        f" CAST(sum({column}) AS BIGINT) AS total FROM {table})"
        for name, table, column in (
            ("ngrams", "grams", "count"), ("prefixes", "prefixes", "sum_count"),
            ("top", "top", "sum_count"),
        )
    )


def _count_rows(n: int, table: str = "documents", extra: str = "") -> str:
    return _samples(table) + _grams(n) + f"\nSELECT {_ids(n)}, count{extra} FROM grams"


_CHUNK = f", CAST(id0 % {CHUNKS} AS INTEGER) AS id0_chunk"
_PREFIX_COLUMNS = "sum_count, max_count, frac_max"


def _partials(n: int) -> str:
    return (
        _samples()
        + f"""
SELECT CAST(sample // {BATCH} AS BIGINT) AS batch, {_ids(n)}, count(*) AS count{_CHUNK}
FROM ({_runs(n)}) GROUP BY ALL"""
    )


ORACLE: dict[str, str] = {
    "documents_by_shard": f"""
SELECT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, count(*) AS n_rows,
       CAST(sum(count(*)) OVER () AS BIGINT) AS total_rows FROM documents GROUP BY ALL""",
    "shard_range": f"""
SELECT CAST(doc_id % {SHARDS} AS INTEGER) AS shard, doc_id, text FROM documents
WHERE doc_id % {SHARDS} BETWEEN 1 AND 2""",
    "token_counts": "WITH "
    + _source("documents")
    + TOK
    + " SELECT token, count(*) AS count FROM tok GROUP BY token",
    "document_lengths": f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{PATTERN}')) AS INTEGER) AS n_tokens
FROM documents""",
    "vocabulary": "WITH " + _source("documents") + TOK + VOCAB + " SELECT id, token FROM vocab",
    "encoded_documents": _base()
    + """
SELECT shard, doc_id, string_agg(id, ' ' ORDER BY pos) AS ids, CAST(count(*) AS INTEGER) AS n
FROM enc GROUP BY shard, doc_id""",
    "pack_wrap": _samples() + ROWS + " SELECT * FROM rows",
    "pack_nowrap": _base()
    + NOWRAP
    + f"""
SELECT shard, sample, string_agg(id, ' ' ORDER BY cell) AS tokens FROM kept
GROUP BY shard, sample HAVING count(*) = {LENGTH}""",
    "samples_roundtrip": _samples() + ROWS + " SELECT * FROM rows",
    "samples_capped": _samples() + ROWS + " SELECT * FROM rows WHERE sample < 100",
    "batch_cap": _samples()
    + ROWS
    + f" SELECT *, CAST(sample // {BATCH} AS BIGINT) AS batch FROM rows WHERE sample < {2 * BATCH}",
    "decode_samples": _samples()
    + _spelled("cells", "shard, sample", "texts")
    + " SELECT shard, sample, text FROM texts",
    "decoded_documents": "SELECT doc_id, text FROM documents",
    "id_range_check": _samples()
    + """
SELECT shard, count(*) AS n_ids, min(id) AS min_id, max(id) AS max_id,
       CAST(count(*) FILTER (id < 0 OR id > 65535) AS BIGINT) AS n_outside
FROM cells GROUP BY shard""",
    "ngrams_exploded": _samples() + f" SELECT shard, sample, id0, id1 FROM ({_runs(2)})",
    "ngram_partials": _partials(2),
    "ngram_recombine": _count_rows(3),
    "chunk_sizes": _samples()
    + _grams(2)
    + f"""
SELECT CAST(id0 % {CHUNKS} AS INTEGER) AS id0_chunk, count(*) AS n_ngrams,
       CAST(sum(count) AS BIGINT) AS n_occurrences FROM grams GROUP BY ALL""",
    "chunk_scan": _count_rows(3, extra=_CHUNK) + f" WHERE id0 % {CHUNKS} = 7",
    "union_chunks": _count_rows(3, extra=_CHUNK),
    "unigrams": _count_rows(1),
    "bigrams": _count_rows(2),
    "trigrams": _count_rows(3),
    "fourgrams": _count_rows(4),
    "bigram_prefixes": _samples() + _grams(2) + _prefixes(2) + " SELECT * FROM prefixes",
    "trigram_prefixes": _samples() + _grams(3) + _prefixes(3) + " SELECT * FROM prefixes",
    "top_bigrams": _samples() + _grams(2) + _prefixes(2) + _top(2) + " SELECT * FROM top",
    "top_trigrams": _samples() + _grams(3) + _prefixes(3) + _top(3) + " SELECT * FROM top",
    "top_trigrams_by_count": _samples()
    + _grams(3)
    + _prefixes(3)
    + _top(3)
    + " SELECT *, row_number() OVER (ORDER BY sum_count DESC, id0, id1, id2) AS rank FROM top",
    "token_lookup_misses": _samples()
    + _grams(3)
    + """
SELECT position, count(*) AS n_ids, count(*) FILTER (token IS NULL) AS n_missing
FROM (SELECT DISTINCT 0 AS position, id0 AS id FROM grams
      UNION ALL SELECT DISTINCT 1, id1 FROM grams
      UNION ALL SELECT DISTINCT 2, id2 FROM grams) LEFT JOIN vocab USING (id)
GROUP BY position""",
    "prefix_rank_in_chunk": _ranked(3),
    "fourgram_prefix_rank_in_chunk": _ranked(4),
    "top_bigrams_scored": _scored(2),
    "top_trigrams_scored": _scored(3),
    "score_bigrams_by_slice": _score(2),
    "score_trigrams_by_slice": _score(3),
    "scan_windows": _samples()
    + f"""
SELECT shard, sample, cell + 1 AS start, id0 || ' ' || id1 AS long_ids,
       CAST(id1 AS VARCHAR) AS short_ids FROM ({_runs(2)}) WHERE shard = 0""",
    "next_token_dist": _scan_base()
    + f"""
SELECT id0, id1, id2, {_six("p_short")} AS p_short,
       {_six(f"(t.count + {MU} * p_short) / (n + {MU})")} AS p_long, n AS n_context
FROM tri t JOIN short s USING (id1, id2) JOIN ctx USING (id0, id1)""",
    "scan_metrics": _scan_base() + _metrics() + _metric_rows(),
    "scan_hits": _scan_base() + _metrics() + _metric_rows() + f" WHERE {_HIT}",
    "scan_examples": _scan_base() + _metrics() + _examples(2) + "\n" + _EXAMPLE_ROWS + "examples",
    "scan_filter": _scan_base() + _metrics() + _examples(2) + FIRSTS + "\n" + _EXAMPLE_ROWS + "firsts",
    "scan_metrics_wide": _scan_base(WIDE) + _metrics(WIDE) + _metric_rows(WIDE),
    "scan_filter_wide": _scan_base(WIDE)
    + _metrics(WIDE)
    + _examples(WIDE)
    + FIRSTS
    + "\n"
    + _EXAMPLE_ROWS
    + "firsts",
    "scan_top": _scan_base()
    + _metrics()
    + _examples(2)
    + FIRSTS
    + "\n"
    + _EXAMPLE_ROWS
    + """
(SELECT *, row_number() OVER (ORDER BY p_long DESC, text, shard, batch, sample, start) AS rank
 FROM firsts)""",
    "pending_shards": f"""
SELECT DISTINCT CAST(doc_id % {SHARDS} AS INTEGER) AS shard FROM documents
WHERE doc_id % {SHARDS} >= {SHARDS // 2}""",
    "shard_completeness": f"""
SELECT DISTINCT CAST(doc_id % {SHARDS} AS INTEGER) AS shard FROM documents
WHERE doc_id % {SHARDS} >= {SHARDS // 2}""",
    "export_all": _exported(2)
    + " UNION ALL "
    + _exported(3)
    + " UNION ALL SELECT * FROM ("
    + _base()
    + " SELECT 'tokens' AS name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS total FROM vocab)"
    + " UNION ALL SELECT * FROM ("
    + _scan_base()
    + _metrics()
    + _examples(2)
    + FIRSTS
    + " SELECT 'scan_filter' AS name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS total FROM firsts)",
    "export_roundtrip": _count_rows(2, extra=_CHUNK),
    "stream_bigrams": _count_rows(2),
    "stream_bigrams_tiered": _count_rows(2),
    "stream_pack": _samples() + ROWS + " SELECT * FROM rows",
    "conversation_bigrams": _count_rows(2, "conversations"),
    "conversation_top_bigrams": _samples("conversations")
    + _grams(2)
    + _prefixes(2)
    + _top(2)
    + " SELECT * FROM top",
}
