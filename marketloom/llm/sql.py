"""SQL that states the corpus queries where SQL can."""

from .url_filter import FETCH_CYCLE, FETCH_MINUTES, START



def _passes() -> str:
    """Votes in the leaves, then of the lines left over by last word, then by fourth word."""
    out = []
    for k, (key, taken) in enumerate((("own[1:3]", "0"), ("list_append(own[1:3], own[n])", "n"), ("own[1:4]", "4"))):
        shared = min(k, 1)
        out.append(f"""busy{k} AS (SELECT n, {key} AS key FROM rest{k} GROUP BY ALL HAVING count(*) > 1 AND sum(lines) >= 3),
words{k} AS (SELECT *, own[place] AS word FROM (SELECT r.n, key, own, lines, unnest(range(4, r.n + 1)) AS place
  FROM (SELECT *, {key} AS key FROM rest{k}) r JOIN busy{k} b USING (n, key)) WHERE place <> {taken}),
ranked{k} AS (SELECT *, row_number() OVER (PARTITION BY n, key, place ORDER BY votes DESC, word DESC) AS r,
    sum(votes) OVER (PARTITION BY n, key, place) AS total
  FROM (SELECT n, key, place, word, sum(lines) AS votes FROM words{k} GROUP BY ALL)),
fixed{k} AS (SELECT n, key, place, word FROM ranked{k} WHERE r = 1 AND votes * 2 >= total),
follows{k} AS (SELECT * FROM (SELECT n, key, own, lines FROM words{k} JOIN fixed{k} USING (n, key, place, word)
    GROUP BY ALL HAVING count(*) + {shared} >= (n - 3) * 0.7) QUALIFY sum(lines) OVER (PARTITION BY n, key) >= 3),
rest{k + 1} AS (SELECT * FROM rest{k} WHERE own NOT IN (SELECT own FROM follows{k})),
""")
    return "".join(out)


LINE_DEDUP = r"""WITH RECURSIVE
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split),
w AS (SELECT doc_id, pos, list_transform(string_split_regex(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
    '[\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS own FROM l),
lines AS (SELECT doc_id, pos, own, len(own) AS n FROM w WHERE len(own) >= 3),
kinds AS (SELECT n, own, count(*) AS lines FROM lines WHERE n > 3 GROUP BY ALL),
rest0 AS (SELECT * FROM kinds),
""" + _passes() + r"""
templates AS (SELECT own, 0 AS pass, key FROM follows0 UNION ALL SELECT own, 1, key FROM follows1 UNION ALL SELECT own, 2, key FROM follows2),
placed AS (SELECT doc_id, pos, CASE WHEN f.own IS NULL THEN x.own ELSE list_prepend(CAST(pass AS VARCHAR), key) END AS template, x.n,
    f.own IS NOT NULL AS general
  FROM lines x LEFT JOIN templates f ON f.own = x.own),
recurring AS (SELECT template, n, general, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM placed
  GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
heads AS (SELECT p.template, p.n, p.general, first_doc, min(pos) AS first_pos FROM placed p JOIN recurring r
  ON r.template = p.template AND r.n = p.n AND r.general = p.general AND r.first_doc = p.doc_id GROUP BY ALL),
dropped AS (SELECT p.doc_id, list(p.pos) AS gone FROM placed p JOIN heads h
  ON h.template = p.template AND h.n = p.n AND h.general = p.general
  WHERE NOT (p.doc_id = first_doc AND p.pos = first_pos) GROUP BY p.doc_id)
SELECT s.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(
    list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM split s LEFT JOIN dropped d ON d.doc_id = s.doc_id"""

NGRAM_JOIN = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, n"""

URL_FILTER = rf"""WITH
captures AS (SELECT page_id, url, TIMESTAMP '{START}' + to_minutes(page_id * {FETCH_MINUTES} % {FETCH_CYCLE}) AS seen,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT *, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
    string_split(regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '^/|/$', '', 'g'), '/') AS steps FROM captures),
labels AS (SELECT *, string_split(host, '.') AS ls FROM parts WHERE url IS NOT NULL AND host <> ''),
keys AS (
  SELECT page_id, seen, 0 AS rank, 'domain' AS kind, array_to_string(ls[i:], '.') AS key
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM labels)
  UNION SELECT page_id, seen, 1, 'host', host FROM labels
  UNION SELECT page_id, seen, 2, 'prefix', host || '/' || array_to_string(steps[1:i], '/')
    FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM labels)),
entries AS (SELECT kind, key, h FROM (SELECT kind, key, CAST('0x' || substr(md5(kind || '|' || key), 1, 7) AS BIGINT) AS h FROM (SELECT DISTINCT kind, key FROM keys))
  WHERE (kind = 'domain' AND h % 11 = 0) OR (kind = 'host' AND h % 7 = 0) OR (kind = 'prefix' AND h % 5 = 0)),
log AS (SELECT kind, key, 'add' AS action, h % 1000 AS day FROM entries
  UNION SELECT kind, key, 'remove', h % 1000 + 30 + h % 300 FROM entries
  UNION SELECT kind, key, CASE WHEN h % 2 = 0 THEN 'add' ELSE 'remove' END, h % 1000 + 400 + h % 200 FROM entries),
once AS (SELECT kind, key, day, max(action) AS action FROM log GROUP BY ALL),
valid AS (SELECT *, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS until FROM once),
hits AS (SELECT k.page_id, k.kind, k.key, v.day, row_number() OVER (PARTITION BY k.page_id
    ORDER BY k.rank DESC, length(k.key) DESC, k.key DESC) AS r
  FROM keys k JOIN valid v ON v.kind = k.kind AND v.key = k.key AND v.action = 'add'
    AND k.seen >= TIMESTAMP '{START}' + to_days(CAST(v.day AS INTEGER))
    AND (v.until IS NULL OR k.seen < TIMESTAMP '{START}' + to_days(CAST(v.until AS INTEGER))))
SELECT c.page_id, c.url, strftime(c.seen, '%Y-%m-%d %H:%M:%S') AS fetched_at, h.key IS NOT NULL AS blocked,
  h.kind AS match_kind, h.key AS match_key,
  strftime(TIMESTAMP '{START}' + to_days(CAST(h.day AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS listed_since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.r = 1"""


def merkle_sql(levels: int = 5) -> str:
    """The manifest with ``levels`` levels of 16 below and above the subroots; a single node stays as it is."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295)"""
    out = f"""WITH leaves AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lower)}) END AS altered FROM documents),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
a0 AS (SELECT tree, idx, n, leaf AS d FROM ranked),
sa0 AS (SELECT doc_id, leaf, tree, idx, tree AS home, '' AS proof, coalesce(altered, leaf) AS fold FROM ranked)"""
    for name in "ab":
        if name == "b":
            out += f""",
b0 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, d FROM a{levels}),
sb0 AS (SELECT doc_id, leaf, 0 AS tree, tree AS idx, home, proof, fold FROM sa{levels})"""
        for k in range(levels):
            out += f""",
{name}{k + 1} AS (SELECT tree, idx // 16 AS idx, any_value(n) AS was, (any_value(n) + 15) // 16 AS n, list(d ORDER BY idx) AS run,
  CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d FROM {name}{k} GROUP BY tree, idx // 16),
s{name}{k + 1} AS (SELECT doc_id, leaf, s.tree, s.idx // 16 AS idx, home,
  CASE WHEN was = 1 THEN proof ELSE proof || array_to_string(run[:s.idx % 16], '') || array_to_string(run[s.idx % 16 + 2:], '') END AS proof,
  CASE WHEN was = 1 THEN fold ELSE sha256(array_to_string(run[:s.idx % 16], '') || fold || array_to_string(run[s.idx % 16 + 2:], '')) END AS fold
  FROM s{name}{k} s JOIN {name}{k + 1} p ON p.tree = s.tree AND p.idx = s.idx // 16)"""
    return out + f"""
SELECT doc_id, leaf, a{levels}.d AS subroot, b{levels}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{levels}.d AS verified
FROM sb{levels} JOIN a{levels} ON a{levels}.tree = home CROSS JOIN b{levels}"""


MERKLE = merkle_sql()

_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Windows of 10 words, all words of shorter items; near: all words of a window within 5 more places.
DECONTAMINATION = f"""WITH
d AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, ws[k:k + least(len(ws), 10) - 1] AS w FROM (
  SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
w AS (SELECT w, len(w) AS n, row_number() OVER () AS id FROM (SELECT DISTINCT w FROM iw)),
sizes AS (SELECT DISTINCT n FROM w),
grams AS (SELECT d, k, n, ws[k:k + n - 1] AS w FROM (
  SELECT d, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
found AS (SELECT d, k, n, w FROM grams WHERE w IN (SELECT w FROM w)),
hit AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(k, k + n)) AS p FROM found) GROUP BY d),
items AS (SELECT d, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list
  FROM found f JOIN iw ON iw.w = f.w GROUP BY d),
wt AS (SELECT DISTINCT id, n, unnest(w) AS term FROM w),
line AS (SELECT d, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS term FROM d),
often AS (SELECT term, count(*) AS c FROM line GROUP BY term),
many AS (SELECT id, count(*) AS terms FROM wt GROUP BY id),
rare AS (SELECT wt.* FROM wt JOIN often USING (term) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, term) = 1),
seen AS (SELECT DISTINCT r.id, r.n, x.d, y.p, y.term FROM rare r JOIN line x ON x.term = r.term
  JOIN line y ON y.d = x.d AND y.p BETWEEN x.p - r.n - 4 AND x.p + r.n + 4 JOIN wt ON wt.id = r.id AND wt.term = y.term),
near AS (SELECT DISTINCT id, d FROM (SELECT a.id, a.d, a.p FROM seen a JOIN seen b ON b.id = a.id AND b.d = a.d
    AND b.p BETWEEN a.p AND a.p + a.n + 4 JOIN many m ON m.id = a.id GROUP BY a.id, a.d, a.p, terms
  HAVING count(DISTINCT b.term) = terms)),
near_items AS (SELECT d, count(DISTINCT item) AS n FROM near JOIN w ON w.id = near.id JOIN iw ON iw.w = w.w GROUP BY d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(x.n, 0) AS n_near_items
FROM d LEFT JOIN hit ON hit.d = d.d LEFT JOIN items ON items.d = d.d LEFT JOIN near_items x ON x.d = d.d"""

HARD_NEGATIVES = """WITH
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
