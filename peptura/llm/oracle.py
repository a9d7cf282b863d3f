"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {}

_HOST = r"""translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

ORACLE["op7_url_filter"] = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r
), c AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/?$', '')
    END AS canon FROM u
), listed AS (
  SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|free-bets|blog)\.') AND canon IS NOT NULL
), rules(act, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(act, length(h || p)) AS act
  FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, b.rule,
  coalesce(b.act, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON c.canon = l.canon
"""

_W = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_W}')"

ORACLE["op9_decontaminate"] = f"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, least(len(w), 1)))) AS i FROM iw)
), dw AS (
  SELECT doc_id, {_ALNUM} AS w FROM documents
), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, (SELECT DISTINCT n FROM grams))
), hit AS (
  SELECT DISTINCT dg.doc_id, dg.i, dg.n, grams.item_id FROM dg JOIN grams ON dg.n = grams.n AND dg.g = grams.g
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')"

ORACLE["op2_minhash_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

ORACLE["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM w)
), twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1
), cover AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g WHERE g IN (SELECT g FROM twice)
), word AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a
), r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id
"""


# minimax: the smallest capacity by bisection, each one checked by eight greedy steps over the running sums
_REACH = "list_reduce(range(0, {0}), lambda z, i: coalesce(list_max(list_filter(pre, lambda x: x <= z + {1})), z))"
ORACLE["op8_sharding"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, CASE WHEN text IS NULL THEN doc_id END AS own FROM documents
), tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), g AS (
  SELECT text, own, min(doc_id) AS first, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY text, own
), c AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM g, tab WHERE text IS NOT NULL
), o AS (
  SELECT *, CAST(sum(bytes) OVER (ORDER BY first ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM g
), p AS (SELECT list(upto ORDER BY upto) AS pre, max(upto) AS total, max(bytes) AS big FROM o
), s(lo, hi) AS (
  SELECT CAST(greatest(big, ceil(total / 8)) AS BIGINT), total FROM p
  UNION ALL SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, mid, {_REACH.format(9, "mid")} >= total AS ok FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM s WHERE lo < hi), p)
), b AS (SELECT list_transform(range(1, 9), lambda k: {_REACH.format("k + 1", "cap")}) AS bounds FROM (SELECT lo AS cap FROM s WHERE lo = hi), p
), w AS (SELECT text, own, CAST(len(list_filter(bounds, lambda x: x <= upto - bytes)) AS INTEGER) AS shard FROM o, b
), r AS (
  SELECT d.doc_id, d.size, c.crc AS text_crc32, w.shard FROM d JOIN w ON w.text IS NOT DISTINCT FROM d.text AND w.own IS NOT DISTINCT FROM d.own LEFT JOIN c ON c.text = d.text
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r
"""


def _secrets_sql() -> str:
    """Base spans by part and match lengths, and the character models as a table of numbers."""
    from .secrets import CLASSES, PATTERNS, TOKEN, TOKEN_LEAST, char_class, default_samples, train

    pats = [*((k, p.replace("'", "''"), g, least) for k, p, g, least in PATTERNS), ("markov", TOKEN, 0, TOKEN_LEAST)]
    codes = "[" + ",".join(str(char_class(chr(i))) for i in range(128)) + "]"
    table = "[" + ",".join(repr(float(x)) for x in train(default_samples())) + "]"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS k, '{kind}' AS kind, {group} AS grp, {least} AS least, '{pat}' AS pat, string_split_regex(text, '{pat}') AS parts, regexp_extract_all(text, '{pat}') AS ms, "
        f"regexp_extract_all(text, '{pat}', {group}) AS gs FROM docs WHERE regexp_matches(text, '{pat}')"
        for n, (kind, pat, group, least) in enumerate(pats)
    )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}),
places AS (SELECT doc_id, k, kind, least, unnest(range(1, len(ms) + 1)) AS i, parts, ms, gs FROM found),
spans AS (SELECT doc_id, k, kind, ms[i] AS m,
    list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM places WHERE length(gs[i]) >= least),
ends AS (SELECT doc_id, k, kind, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM spans),
model AS (SELECT {codes} AS code, {table} AS llr),
judged AS (SELECT ends.*, list_transform(string_split(m, ''), lambda c: code[ascii(c) + 1]) AS cls, llr FROM ends, model WHERE k = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
random AS (SELECT * FROM judged WHERE list_sum(list_transform(range(1, len(cls)), lambda i: llr[cls[i] * {CLASSES} + cls[i + 1] + 1])) / (len(cls) - 1) >= 1.0),
base AS (SELECT * FROM ends WHERE k < 3),
extra AS (SELECT doc_id, k, kind, m, s, e FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e)),
told AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS x, count(*) FILTER (WHERE k = 2) AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(x, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (doc_id)
"""


ORACLE["op6_secret_scan"] = _secrets_sql()

_TERMS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE["op12_lexical_search"] = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents
), size AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), asked AS (
  SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, size WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), impact AS (
  SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms))) AS impact
  FROM tf JOIN weight USING (term) JOIN d USING (r), size
), score AS (
  SELECT i, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
