"""DuckDB SQL that must give the rows of the queries, for those that SQL can express."""

from __future__ import annotations

from foliant.llm import licenses, quality, urls, warc

#: Each document's words: n counts from 1. {words}: a list expression over documents d.
_WORDS = """w AS (SELECT doc_id, {words} AS ws FROM documents),
     t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS n FROM w)"""
_PLAIN = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BARE = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _runs(n: int, table: str = "t") -> str:
    """Every word with the n words from it on, and how many there are."""
    return f"SELECT *, md5(string_agg(word, ' ') OVER r) AS k, count(*) OVER r AS c FROM {table} WINDOW r AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


SUBSTRINGS = f"""
WITH {_WORDS.format(words=_PLAIN)}, g AS ({_runs(50)}),
     m AS (SELECT k AS h, min(doc_id) AS first FROM g WHERE c = 50 GROUP BY k),
     f AS (SELECT doc_id, n, word, max(CASE WHEN c = 50 AND first < doc_id THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS hit FROM g LEFT JOIN m ON k = h),
     s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (hit >= n - 49) AS n_removed, string_agg(word, ' ' ORDER BY n) FILTER (hit IS NULL OR hit < n - 49) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""

SUFFIXES = """
WITH h AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n_bytes FROM documents),
     c AS (SELECT doc_id, base, n_bytes, substr(x, 2 * base + 1, 2400) AS x FROM (SELECT doc_id, x, n_bytes, unnest(range(0, n_bytes, 1000)) AS base FROM h)),
     p AS (SELECT doc_id, base, n_bytes, x, unnest(range(least(1000, n_bytes - base))) AS j FROM c),
     g AS (SELECT doc_id, base + j AS i, substr(x, 2 * j + 1, 2) AS b, CASE WHEN base + j + 200 <= n_bytes THEN md5(substr(x, 2 * j + 1, 400)) END AS k FROM p),
     m AS (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
     f AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN m.k IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 200, false) AS gone FROM g LEFT JOIN m ON g.k = m.k),
     e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM f),
     s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN s ON h.doc_id = s.doc_id"""

_SPACE = r"[\x20\x09-\x0D]"
_NORMAL = rf"trim(regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '[0-9]', '0', 'g'))"
QUALITY = f"""
WITH {_WORDS.format(words=_PLAIN)}, g AS ({_runs(5)}),
     m AS (SELECT doc_id AS d, k AS h FROM g WHERE c = 5 GROUP BY doc_id, k HAVING count(*) > 1),
     f AS (SELECT doc_id, n, max(CASE WHEN h IS NOT NULL THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS hit FROM g LEFT JOIN m ON k = h AND doc_id = d AND c = 5),
     r AS (SELECT doc_id, count(*) FILTER (hit >= n - 4) AS n_repeat_words FROM f GROUP BY doc_id),
     l AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
     u AS (SELECT doc_id, count(line) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
     b AS (SELECT source, {_NORMAL} AS norm, count(DISTINCT text) AS docs FROM l WHERE {_NORMAL} <> '' GROUP BY ALL),
     a AS (SELECT source, count(DISTINCT coalesce(text, '')) AS size FROM documents GROUP BY source),
     o AS (SELECT b.source, norm FROM b JOIN a ON b.source IS NOT DISTINCT FROM a.source WHERE docs >= {quality.MIN_DOCS} AND docs > {quality.SHARE} * size),
     x AS (SELECT doc_id, sum(len(string_split({_NORMAL}, ' '))) AS lost FROM l JOIN o ON l.source IS NOT DISTINCT FROM o.source AND {_NORMAL} = norm GROUP BY doc_id),
     y AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0)::BIGINT AS word_chars,
                  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
           FROM w JOIN documents d ON w.doc_id = d.doc_id LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN u ON w.doc_id = u.doc_id LEFT JOIN x ON w.doc_id = x.doc_id),
     z AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {quality.DEPLETED} * n_words AS kept FROM z"""

_PHRASES = " ".join("WHEN " + " AND ".join(f"x{i} = '{w}'" for i, w in enumerate(p.split())) + f" THEN '{label}'" for p, label in licenses.PHRASES)
_LEADS = ", ".join(f"lead(word, {i}) OVER r AS x{i}" for i in range(max(len(p.split()) for p, _ in licenses.PHRASES)))
_TEMPLATES = ", ".join(f"('{label}', {licenses.tokens_of(text)!r})" for label, text in licenses.TEMPLATES)
LICENSES = f"""
WITH {_WORDS.format(words=_BARE.format(_LOWER))}, q AS (SELECT doc_id, n, {_LEADS} FROM t WINDOW r AS (PARTITION BY doc_id ORDER BY n)),
     p AS (SELECT doc_id, n - 1 AS pos, CASE {_PHRASES} END AS label FROM q), b AS (SELECT * FROM p WHERE label IS NOT NULL),
     y(label, tokens) AS (VALUES {_TEMPLATES}),
     k AS (SELECT doc_id, unnest(string_split({_LOWER}, chr(10)) || string_split_regex({_LOWER}, '\\n[\\x20\\x09-\\x0D]*\\n')) AS block FROM documents),
     v AS (SELECT doc_id, {_BARE.format("block")} AS ws FROM k),
     s AS (SELECT doc_id, label, len(list_intersect(list_distinct(ws), tokens)) / len(tokens) AS score FROM v, y WHERE len(list_intersect(list_distinct(ws), tokens)) >= ceil({licenses.THRESHOLD} * len(tokens) - 1e-9)),
     e AS (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM s),
     i AS (SELECT doc_id, count(*) AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
     j AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM e GROUP BY doc_id), o AS (SELECT doc_id, max(score) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN i ON w.doc_id = i.doc_id LEFT JOIN j ON w.doc_id = j.doc_id LEFT JOIN o ON w.doc_id = o.doc_id"""

#: Windows of 13 words, and of shorter items their own length: one pass over the documents for each length.
_LENGTHS = range(1, 14)
_ITEM = f"""i AS (SELECT item_id AS doc_id, {_BARE.format(_LOWER)} AS ws FROM benchmark), iw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS n, least(len(ws), 13) AS size FROM i),
     ig AS ({" UNION ALL ".join(f"SELECT doc_id, {n} AS size, k FROM ({_runs(n, f'(SELECT * FROM iw WHERE size = {n})')}) WHERE c = {n}" for n in _LENGTHS)}), il AS (SELECT DISTINCT doc_id AS item, size, k FROM ig)"""
_DOCS = " UNION ALL ".join(f"SELECT doc_id, n, {n} AS size, k FROM ({_runs(n, f'(SELECT * FROM t WHERE EXISTS (SELECT 1 FROM il WHERE size = {n}))')}) WHERE c = {n}" for n in _LENGTHS)
DECONTAMINATION = f"""
WITH {_WORDS.format(words=_BARE.format(_LOWER))}, {_ITEM}, g AS ({_DOCS}),
     h AS (SELECT g.doc_id, n, g.size, item FROM g JOIN il ON g.size = il.size AND g.k = il.k),
     f AS (SELECT t.doc_id, t.n, max(h.n + h.size) OVER (PARTITION BY t.doc_id ORDER BY t.n) > t.n AS hit FROM t LEFT JOIN (SELECT doc_id, n, max(size) AS size FROM h GROUP BY ALL) h ON t.doc_id = h.doc_id AND t.n = h.n),
     s AS (SELECT doc_id, count(*) FILTER (hit) AS n_hit FROM f GROUP BY doc_id),
     o AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN o ON w.doc_id = o.doc_id"""

ORACLES: dict[str, str] = {
    "op2_warc_archives": warc.ORACLE_SQL, "op3_url_filter": urls.oracle_sql(), "op4_substring_dedup": SUBSTRINGS, "op5_quality_rules": QUALITY, "op6_license_scan": LICENSES, "op7_decontamination": DECONTAMINATION, "op9_suffix_dedup": SUFFIXES,
}
