"""SQL that gives the rows of queries that SQL can express, in DuckDB's dialect, from the operators' own constants."""

from __future__ import annotations

import math

from . import collocations, filter_audit, licenses, secrets
from .substring_dedup import WINDOW


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return f"[{', '.join(map(_quoted, words))}]"


def substring_dedup_sql() -> str:
    """Joins every window with the smallest document that has it."""
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
 m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY g),
 c AS (SELECT DISTINCT x.doc_id, x.i + d AS p FROM x JOIN m USING (g), (SELECT unnest(range({WINDOW})) AS d) WHERE least < x.doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
 k AS (SELECT v.doc_id, string_agg(v.v, ' ' ORDER BY v.p) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM w) v LEFT JOIN c ON c.doc_id = v.doc_id AND c.p = v.p WHERE c.p IS NULL GROUP BY v.doc_id)
 SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


def license_scan_sql() -> str:
    """Compares every line and every passage with every template, and every place with every phrase."""
    phrases = ", ".join(f"({_list(p.split())}, {_quoted(label)})" for p, label in licenses.PHRASES.items())
    length = lambda t: math.ceil(len(licenses.python_words(t)) / licenses.THRESHOLD - 1e-9)
    templates = ", ".join(f"({_list(sorted(set(licenses.python_words(t))))}, {length(t)}, {_quoted(label)})" for label, texts in licenses.TEMPLATES.items() for t in texts)
    enough = f"{licenses.THRESHOLD} * len(tokens) - 1e-9"
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS x FROM documents), t AS (SELECT * FROM (VALUES {templates}) t(tokens, long, label)),
 w AS (SELECT doc_id, regexp_extract_all(x, '{licenses.WORD}') AS w FROM d),
 f AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(phrase) + 2), lambda i: w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase)) AS i FROM w, (VALUES {phrases}) p(phrase, label))),
 b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM f GROUP BY doc_id),
 l AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{licenses.WORD}')) AS s FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d)),
 h AS (SELECT doc_id, label, len(list_intersect(s, tokens)) / len(tokens)::DOUBLE AS share FROM l, t WHERE len(s) >= {enough} AND len(list_intersect(s, tokens)) >= {enough}
  UNION ALL SELECT doc_id, label, max(len(list_intersect(w[i:i + long - 1], tokens))) / len(tokens)::DOUBLE AS share FROM (SELECT doc_id, w, label, tokens, long, unnest(range(1, len(w) + 1)) AS i FROM w, t WHERE len(list_intersect(w, tokens)) >= {enough}) GROUP BY doc_id, label, tokens HAVING max(len(list_intersect(w[i:i + long - 1], tokens))) >= {enough}),
 m AS (SELECT doc_id, list(DISTINCT label) AS met, max(share) AS share FROM h GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels, CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
 FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""


def secret_scan_sql() -> str:
    """Places from splits and matches, then counts of owners by value."""
    kinds = []
    for rank, (kind, pattern, group, least, musts) in enumerate(secrets.BASE + secrets.MORE):
        p = _quoted(pattern)
        must = "".join(f" AND regexp_matches(value, {_quoted(m)})" for m in musts)
        kinds.append(
            f"""SELECT doc_id, owner, repository, {rank} AS rank, '{kind}' AS kind, begins, begins + length(m[k]) AS ends, value FROM (SELECT *, v[k] AS value, CAST(list_sum(list_transform(g[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda s: length(s))), 0) AS BIGINT) AS begins
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, owner, repository, string_split_regex(x, {p}) AS g, regexp_extract_all(x, {p}) AS m, regexp_extract_all(x, {p}, {group}) AS v FROM d WHERE regexp_matches(x, {p})))) WHERE length(value) >= {least}{must}"""
        )
    base, text = len(secrets.BASE), "string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, rank)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k[0]}') AS BIGINT) AS n_{k[0]}" for k in secrets.BASE)
    zeros = ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents), s AS ({" UNION ALL ".join(kinds)}),
 o AS (SELECT lower(value) AS low, count(DISTINCT owner) >= {secrets.MANY_OWNERS} OR count(DISTINCT (owner, repository)) >= {secrets.MANY_REPOSITORIES} AS copied FROM s GROUP BY lower(value)),
 j AS (SELECT s.*, copied OR regexp_matches(value, {_quoted(secrets.PLACEHOLDER)}) OR replace(value, substr(value, 1, 1), '') = '' AS example FROM s JOIN o ON o.low = lower(s.value)),
 r AS (SELECT doc_id, {counts}, {text} FILTER (rank < {base}) AS base, {text} FILTER (rank < {base} OR NOT example) AS every, count(*) FILTER (NOT example) AS live, count(*) FILTER (example) AS example FROM j GROUP BY doc_id)
 SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, CAST(coalesce(live, 0) AS BIGINT) AS n_live, CAST(coalesce(example, 0) AS BIGINT) AS n_example FROM d LEFT JOIN r USING (doc_id)"""


def filter_audit_sql() -> str:
    """Counts of failure masks, and for each order and step sums over the masks that fit."""
    fails = " ".join(f"WHEN '{f}' THEN {1 << i}" for i, f in enumerate(filter_audit.FILTERS))
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 e AS (SELECT x, min(doc_id) AS least FROM d GROUP BY x),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < {filter_audit.FEW_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(d.x, '[^A-Z]', '', 'g')) > {filter_audit.UPPER_PERCENT} * length(d.x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(d.x, '{filter_audit.SYMBOLS}') THEN 8 ELSE 0 END + CASE WHEN least < d.doc_id THEN 16 ELSE 0 END AS mask
 FROM d JOIN e USING (x) LEFT JOIN l USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), b AS (SELECT f, CASE f {fails} END AS bit FROM f),
 o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM f v, f w, f x, f y, f z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
 s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bit, (SELECT coalesce(sum(bit), 0) FROM b q WHERE contains(substr(filter_order, 1, step - 1), q.f)) AS before FROM o, (SELECT unnest(range(1, 6)) AS step), b WHERE b.f = substr(filter_order, step, 1)),
 r AS (SELECT part, filter_order, step, bit, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
 CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost FROM c, (SELECT filter_order, step, CAST(bit AS BIGINT) AS bit, CAST(before AS BIGINT) AS before FROM s) GROUP BY ALL)
 SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def collocations_sql() -> str:
    """Counts every run of up to three words, and joins candidates with the parts of each cut."""
    k, least = collocations.LONGEST, collocations.LEAST
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {k + 1})) AS k) WHERE len(w) >= k)),
 f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= {least}),
 u AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS more FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM c, (SELECT unnest(range(2, {k})) AS s) WHERE s < k) GROUP BY ALL),
 x AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c LEFT JOIN u USING (lang, phrase) WHERE more IS NULL OR 100 * more < {collocations.COVERED_PERCENT} * a),
 s AS (SELECT x.lang, x.phrase, x.a, cut, l.n AS l, r.n AS r, ({collocations.SCALE}::HUGEINT * x.a * x.a) // (l.n::HUGEINT * r.n) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
 SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, CAST(score AS BIGINT) AS score FROM b JOIN t ON t.lang = b.lang QUALIFY rank <= {collocations.KEEP}"""
