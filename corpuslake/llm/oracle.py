"""DuckDB SQL for the queries that SQL can express; the fixed values come from the operators."""

from __future__ import annotations

from corpuslake.llm import decontaminate, divergence, licenses, mixing, urls

OP8 = r"""
WITH listed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i + 1 : i + 35], ' ') AS passage
  FROM (SELECT r, words, unnest(range(0, len(words) - 34)) AS i FROM listed WHERE len(words) >= 35)
), repeated AS (
  SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (passage)
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM listed WHERE len(words) > 0
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM placed ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (r)
"""


def op9() -> str:
    rows, own = [], licenses.telling(licenses.TEMPLATES)
    for i, (text, label) in enumerate([*licenses.PHRASES.items(), *licenses.TEMPLATES.items()]):
        base = i < len(licenses.PHRASES)
        k, words = (2, licenses._words(text)) if base else (4, licenses._words(text))
        rows += [f"({i}, '{label}', {base}, {len(words) - k + 1}, {k}, {t}, '{' '.join(words[t : t + k])}', {base or own[i - len(licenses.PHRASES)][t]})" for t in range(len(words) - k + 1)]
    return rf"""
WITH grams(template, label, base, grams, k, t, gram, own) AS (VALUES {", ".join(rows)}), listed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), places AS (
  SELECT r, words, unnest(range(0, len(words))) AS p FROM listed WHERE len(words) > 0
), rolling AS (
  SELECT r, p, 2 AS k, array_to_string(words[p + 1 : p + 2], ' ') AS gram FROM places WHERE p + 2 <= len(words)
  UNION ALL SELECT r, p, 4, array_to_string(words[p + 1 : p + 4], ' ') FROM places WHERE p + 4 <= len(words)
), hits AS (
  SELECT r, template, label, base, grams, k, t, own, p - t AS diagonal FROM rolling JOIN grams USING (k, gram)
), apart AS (
  SELECT *, CASE WHEN base OR lag(diagonal) OVER w IS NULL OR diagonal - lag(diagonal) OVER w > {licenses.GAP} THEN 1 ELSE 0 END AS starts
  FROM (SELECT DISTINCT r, template, base, diagonal FROM hits) WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM apart
), spans AS (
  SELECT r, template, label, base, span, min(diagonal) AS start, count(DISTINCT w)::DOUBLE / any_value(grams + k - 1) AS share, bool_or(own) AS own
  FROM (SELECT h.*, span, unnest(range(t, t + k)) AS w FROM hits h JOIN numbered n USING (r, template, diagonal)) GROUP BY r, template, label, base, span
), docs AS (
  SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(start) FILTER (base AND share = 1) AS first_word, max(start) FILTER (base AND share = 1) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base AND share = 1)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN share = 1 ELSE own AND share >= 0.8 END)), ',') AS labels,
    max(share) FILTER (CASE WHEN base THEN share = 1 ELSE own AND share >= 0.8 END) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM listed LEFT JOIN docs USING (r)
"""


OP3 = rf"""
WITH read AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS rk, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), shown AS (
  SELECT *, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS shown, length(regexp_replace(text, '[\x20\x09-\x0D\p{{L}}]+', '', 'g')) AS other FROM read
), bucketed AS (
  SELECT *, [CASE WHEN shown > 0 THEN 20 * (shown - other) // shown ELSE 0 END, least(CASE WHEN size > 0 THEN shown // size ELSE 0 END, 20), least(size // 100, 30)] AS b FROM shown
), known AS (
  SELECT b, good FROM bucketed JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id)
), prior AS (
  SELECT (coalesce(sum(good), 0) + 1)::DOUBLE / (count(*) + 2) AS p FROM known
), odds AS (
  SELECT f, bucket, round(ln((sum(good) + {mixing.PRIOR} * any_value(p)) / (count(*) - sum(good) + {mixing.PRIOR} * (1 - any_value(p)))) - ln(any_value(p) / (1 - any_value(p))), 6) AS odds
  FROM (SELECT good, unnest([1, 2, 3]) AS f, unnest(b) AS bucket FROM known), prior GROUP BY f, bucket
), weighed AS (
  SELECT d.*, greatest({mixing.LEAST}::DOUBLE, round(1 / (1 + exp(-(round(ln(p / (1 - p)), 6) + coalesce(x.odds, 0.0) + coalesce(y.odds, 0.0) + coalesce(z.odds, 0.0)))), 6)) AS quality
  FROM bucketed d CROSS JOIN prior LEFT JOIN odds x ON x.f = 1 AND x.bucket = d.b[1] LEFT JOIN odds y ON y.f = 2 AND y.bucket = d.b[2] LEFT JOIN odds z ON z.f = 3 AND z.bucket = d.b[3]
), drawn AS (
  SELECT doc_id, source, rk, size, -ln((('0x' || substr(md5(concat_ws('/', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), rk)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / quality AS draw
  FROM weighed
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source
), ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM sizes
), filled AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS words, coalesce(sum(source_size) OVER f, 0)::DOUBLE AS before, (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS open
  FROM ranked WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, greatest(0.0::DOUBLE, 1.5::DOUBLE * words - 2.0::DOUBLE * before) / open AS level FROM filled
), settled AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(max(level) FILTER (level * weight < 2.0::DOUBLE * source_size) OVER () * weight, 2.0::DOUBLE * source_size)) AS target FROM leveled
), summed AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, rk, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM drawn d JOIN settled s ON d.source IS NOT DISTINCT FROM s.source
), epochs AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM summed
)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - (upto - size))))::BIGINT AS taken FROM epochs
"""


def op5() -> str:
    fits = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}} END" for h, p, v in sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r))]
    low, high = f"{1 / (urls.MOST_STRENGTH + 1)!r}::DOUBLE", f"{1 / (urls.LEAST_STRENGTH + 1)!r}::DOUBLE"

    def level(name: str, of: str) -> str:
        m = f"(1 / greatest({low}, least({high}, coalesce((sum(power(bad / n - parent, 2) - parent * (1 - parent) / n) FILTER (n > 1) OVER ()) / nullif(sum(parent * (1 - parent) * (1 - 1 / n)) FILTER (n > 1) OVER (), 0), {low}))) - 1)"
        return f"""{name}_m AS (SELECT *, {m} AS m FROM {of}), {name}_s AS (SELECT *, (m * parent + bad) / (m + n) AS mean FROM {name}_m),
{name}_v AS (SELECT *, round(mean, 9) AS rate, round(mean * (1 - mean) / (m + n + 1) + power(m / (m + n), 2) * parent_var, 12) AS var FROM {name}_s),
{name} AS (SELECT *, round(greatest(0.0::DOUBLE, rate - 1.645::DOUBLE * sqrt(var)), 9) AS lower FROM {name}_v)"""

    return rf"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), named AS (
  SELECT *, coalesce({", ".join(fits)}) AS fit, array_to_string(string_split(host, '.')[-2:], '.') AS two, string_split(host, '.')[-1] AS one, array_to_string(string_split(host, '.')[-3:], '.') AS three FROM parsed
), split AS (
  SELECT *, CASE WHEN regexp_matches(two, '{urls.WIDE_SUFFIX}') THEN two ELSE one END AS suffix, CASE WHEN regexp_matches(two, '{urls.WIDE_SUFFIX}') THEN three ELSE two END AS domain FROM named
), outcomes AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END) AS bad
  FROM (SELECT page_id, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT) AS shown FROM parsed) JOIN labels ON shown = doc_id GROUP BY page_id
), hosts AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM split JOIN outcomes USING (page_id) WHERE bad IS NOT NULL GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), top AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM suffixes
), every_v AS (
  SELECT round((1 + bad) / (2 + n), 9) AS rate, round((1 + bad) * (1 + n - bad) / ((2 + n) * (2 + n) * (3 + n)), 12) AS var FROM top
), every AS (SELECT *, round(greatest(0.0::DOUBLE, rate - 1.645::DOUBLE * sqrt(var)), 9) AS lower FROM every_v
), suffix_in AS (SELECT suffixes.*, rate AS parent, var AS parent_var FROM suffixes, every), {level("by_suffix", "suffix_in")},
domain_in AS (SELECT domains.*, s.rate AS parent, s.var AS parent_var FROM domains JOIN by_suffix s USING (suffix)), {level("by_domain", "domain_in")},
host_in AS (SELECT hosts.*, d.rate AS parent, d.var AS parent_var FROM hosts JOIN by_domain d USING (domain)), {level("by_host", "host_in")}
SELECT s.page_id, s.host, s.path, s.fit.rule AS rule, coalesce(h.rate, d.rate, u.rate, every.rate) AS bad_rate, coalesce(h.lower, d.lower, u.lower, every.lower) AS bad_lower,
  coalesce(s.fit.verdict, CASE WHEN coalesce(h.lower, d.lower, u.lower, every.lower) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM split s CROSS JOIN every LEFT JOIN by_host h ON h.host = s.host LEFT JOIN by_domain d ON d.domain = s.domain LEFT JOIN by_suffix u ON u.suffix = s.suffix
"""


OP11 = r"""
WITH bits AS (SELECT range AS i, range::BIGINT AS x0 FROM range(256)), STEPS, crcs AS (SELECT list(x8 ORDER BY i) AS t FROM bits8
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, size
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || '/' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)
), counts AS (
  SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS lead,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM counts CROSS JOIN crcs
), convs AS (
  SELECT c.conv_id, c.lead, c.h::BIGINT AS h, least(c.h, coalesce(l.n, 0))::BIGINT AS taken FROM hashed c LEFT JOIN counts l ON l.conv_id = c.lead
), rebuilt AS (
  SELECT c.conv_id, t.place, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.lead WHERE t.place <= c.taken
  UNION ALL SELECT c.conv_id, t.place - c.h + c.taken, t.digest, t.size FROM convs c JOIN turns t USING (conv_id) WHERE t.place > c.h
), listed AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY place) FILTER (place IS NOT NULL), []) AS digests, coalesce(list(size ORDER BY place) FILTER (place IS NOT NULL), []) AS sizes FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, len(digests) AS length, array_to_string(digests[1 : d], '') AS key, CASE WHEN d > 0 THEN array_to_string(digests[1 : d - 1], '') END AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS d FROM listed)
), nodes AS (
  SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, key
), children AS (
  SELECT above, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above, depth
), whole AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.above = n.key AND c.depth = n.depth
), held AS (
  SELECT p.depth, p.key, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved_tokens FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.depth, p.key
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.key = w.above JOIN held h ON h.depth = w.depth AND h.key = w.key
""".replace("STEPS", ", ".join(f"bits{k + 1} AS (SELECT i, CASE WHEN x{k} & 1 = 1 THEN xor(x{k} >> 1, 3988292384::BIGINT) ELSE x{k} >> 1 END AS x{k + 1} FROM bits{k or ''})" for k in range(8)))

OP12 = rf"""
WITH listed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words FROM documents
), asked AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}') AS words FROM benchmark
), grams AS (
  SELECT DISTINCT item, n, array_to_string(words[i + 1 : i + n], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(words) - n + 1)) AS i FROM (SELECT *, least({decontaminate.N}, len(words)) AS n FROM asked WHERE len(words) > 0))
), windows AS (
  SELECT r, n, i, array_to_string(words[i + 1 : i + n], ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM listed CROSS JOIN (SELECT DISTINCT n FROM grams) WHERE len(words) >= n)
), hits AS (
  SELECT r, n, i, item FROM windows JOIN grams USING (n, gram)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM listed LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP13 = rf"""
WITH listed AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{divergence.WORD}') AS words FROM documents
), placed AS (SELECT r, lang, source, unnest(words) AS term FROM listed
), kept AS (SELECT lang, term, count(*) AS n FROM placed GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}
), counts AS (SELECT lang, source, term, count(*) AS n FROM placed SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM listed) LEFT JOIN kept USING (lang) GROUP BY lang
), totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), groups AS (SELECT lang, source, coalesce(t.total, 0)::HUGEINT AS total, v, l.total AS lang_total FROM (SELECT DISTINCT lang, source FROM listed) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
), rates AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p, 1 + ({divergence.SCALE}::HUGEINT * (kept.n + 1)) // (lang_total + v) AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN rates x ON x.lang = a.lang AND x.source = a.source LEFT JOIN rates y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM rates WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

ORACLE_SQL = {"op3_mixing": OP3, "op5_urls": op5(), "op8_substring": OP8, "op9_licenses": op9(), "op11_prefix_trie": OP11, "op12_decontaminate": OP12, "op13_divergence": OP13}
