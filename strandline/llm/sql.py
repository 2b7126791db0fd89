"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .mixing import LEVELS, Params


def _weights(level: str, p: Params) -> str:
    cases = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in p.weights.get(level, {}).items())
    return f"CASE{cases} ELSE {p.other} END" if cases else str(p.other)


def _pour(name: str, parent: list[str], level: str, src: str, p: Params) -> str:
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    keep = ", ".join([*parent, level])
    order = f"({by}ORDER BY CAST(cap AS DOUBLE) / w, {level}"
    return f"""{name}1 AS (SELECT *, {_weights(level, p)} AS w FROM ({src})),
{name}2 AS (SELECT *, CAST(cap AS HUGEINT) * sum(w) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (budget - coalesce(sum(cap) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * CAST(w AS HUGEINT) AS f0 FROM {name}1),
{name}3 AS (SELECT *, min(f0::INT) OVER {order} ROWS UNBOUNDED PRECEDING) = 1 AS fits FROM {name}2),
{name}4 AS (SELECT *, budget - sum(CASE WHEN fits THEN cap ELSE 0 END) OVER ({by}) AS lft, sum(CASE WHEN fits THEN 0 ELSE w END) OVER ({by}) AS share FROM {name}3),
{name} AS (SELECT {keep}, cap, CASE WHEN fits THEN cap ELSE least(cap, CAST(lft AS HUGEINT) * w // share) END AS alloc FROM {name}4)"""


def mixing_sql(p: Params = Params()) -> str:
    leaf = ", ".join(LEVELS)
    return f"""WITH base AS (SELECT doc_id, try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) % 3 AS k, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
 CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
slim AS (SELECT doc_id, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE '(none)' END AS domain, lang, source, tokens FROM base),
leaves AS (SELECT {leaf}, sum(tokens) AS tokens, sum(tokens) * {p.epochs} AS cap FROM slim GROUP BY ALL),
tot AS (SELECT least(sum(tokens) * {p.budget[0]} // {p.budget[1]}, sum(cap)) AS budget FROM leaves),
{_pour("dom", [], "domain", "SELECT domain, sum(cap) AS cap, any_value(budget) AS budget FROM leaves, tot GROUP BY 1", p)},
{_pour("lng", ["domain"], "lang", "SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(d.alloc) AS budget FROM leaves l JOIN dom d USING (domain) GROUP BY 1, 2", p)},
{_pour("lf", ["domain", "lang"], "source", "SELECT l.domain, l.lang, l.source, l.cap, g.alloc AS budget FROM leaves l JOIN lng g ON l.domain = g.domain AND l.lang = g.lang", p)},
plan AS (SELECT {leaf}, tokens AS lt, CASE WHEN tokens > 0 THEN CAST(alloc // tokens AS BIGINT) ELSE 0 END AS epoch, alloc FROM leaves JOIN lf USING ({leaf})),
rows0 AS (SELECT s.*, lt, epoch, alloc - epoch * lt AS rest, md5('{p.seed}:' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM slim s JOIN plan USING ({leaf})),
rows1 AS (SELECT *, CAST('0x' || left(k, 8) AS BIGINT) % {p.slices} AS slice FROM rows0),
rows2 AS (SELECT *, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY slice, k, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM rows1),
rows3 AS (SELECT *, max(CASE WHEN run > rest THEN 1 ELSE 0 END) OVER (PARTITION BY {leaf} ORDER BY slice, k, doc_id ROWS UNBOUNDED PRECEDING) AS beyond FROM rows2)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch + CASE WHEN lt > 0 AND rest > 0 AND beyond = 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM rows3"""


WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY 1)
SELECT d.page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN top IS NULL OR n < 1000 OR top IS NOT DISTINCT FROM d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN top IS NULL OR n < 1000 OR top IS NOT DISTINCT FROM d.page_id THEN NULL ELSE top END AS refers_to FROM d LEFT JOIN m ON m.h = d.h"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT t.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(low, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(low, t.vec_id)) AS kept
 FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN c ON c.a = t.vec_id"""

SHINGLES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : least(i + 3, len(ws))], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

PASSAGES = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY 1),
m AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE low < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
y AS (SELECT doc_id, word, i, count(m.i) OVER (PARTITION BY doc_id ORDER BY x.i ROWS 49 PRECEDING) > 0 AS gone FROM x LEFT JOIN m USING (doc_id, i)),
k AS (SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM y GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

ORACLES = {"op2_embedding_neardup": VECTORS, "op5_minhash_neardup": SHINGLES, "op6_substring_dedup": PASSAGES, "op7_mixing": mixing_sql(), "op10_warc": WARC}
