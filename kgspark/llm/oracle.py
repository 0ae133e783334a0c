"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from kgspark.llm import pii
from kgspark.llm.collocations import LEAST, TOP
from kgspark.llm.collocations import SHARE as PART
from kgspark.llm.mixing import MOST, SHARE, SLOPES, WEIGHTS
from kgspark.llm.url_filter import CONFIDENCE, DEFAULT, RULES, SUPPORT

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _descent(name: str, shards: int) -> str:
    """CTEs that end in name(row, shard): draws in a tree of two regions of four racks of five shards, weights 1.

    Shard 40 of the grown tree is a layer of its own with weight 1: its region draws beside the two old ones.
    """
    score = lambda child, weight: f"-ln((('0x' || substr(md5(concat_ws('/', key, {child})), 1, 12))::UBIGINT::DOUBLE + 1) / (281474976710656.0::DOUBLE + 1)) / {weight}::DOUBLE"
    grown = ", ('1:g1', 1.0)" if shards == 41 else ""
    step = lambda at, parent, children, weight, path: f"SELECT row, key, {path} AS path FROM (SELECT row, key, arg_min(n, ({score(children, weight)}, {children})) AS n, parent FROM (SELECT row, key, path AS parent, unnest(range({5 if parent == 'rack' else 4})) AS n FROM {at} WHERE NOT starts_with(path, '1:')) GROUP BY row, key, parent)"
    return f"""{name}0 AS (SELECT row, key, arg_min(child, ({score("child", "weight")}, child)) AS path FROM d, (VALUES ('0:g0', 20.0), ('0:g1', 20.0){grown}) t(child, weight) GROUP BY row, key),
  {name}1 AS ({step(name + "0", "region", "parent || '/k' || n", "5.0", "parent || '/k' || n")}), {name}2 AS ({step(name + "1", "rack", "parent || '/' || (right(split_part(parent, '/', 1), 1)::INT * 20 + right(parent, 1)::INT * 5 + n)", "1.0", "right(split_part(parent, '/', 1), 1)::INT * 20 + right(parent, 1)::INT * 5 + n")}),
  {name} AS (SELECT row, path::INTEGER AS shard FROM {name}2 UNION ALL SELECT row, 40 FROM {name}0 WHERE starts_with(path, '1:'))"""


def _shards() -> str:
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "(SELECT list(v ORDER BY n) FROM (SELECT n, list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: " + step + ") AS v FROM range(256) t(n)))"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(text)), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key FROM documents), {_descent("old", 40)}, {_descent("grown", 41)},
  crc AS (SELECT row, {crc} AS text_crc32 FROM (SELECT row, text, hex(encode(text)) AS hexed, {table} AS crc_table FROM d)),
  placed AS (SELECT d.*, text_crc32, strlen(text) AS n, ('0x' || substr(md5(concat_ws('/', key, text_crc32::VARCHAR, strlen(text)::VARCHAR)), 1, 8))::BIGINT % 256 AS bucket FROM d JOIN crc USING (row))
  SELECT doc_id, n + 16 AS size, text_crc32, 'key' AS law, old.shard, row_number() OVER (PARTITION BY old.shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, n) - 1 AS slot, grown.shard AS grown_shard
  FROM placed JOIN old USING (row) JOIN grown USING (row)"""


def _mix() -> str:
    pick = lambda xs: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in xs) + f"][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(xs)} + 1]"
    at = lambda x: f"CASE WHEN {x} <= 0 THEN 0.0::DOUBLE ELSE 2 * {x} / (rest + sqrt(rest * rest + 4 * slope * {x})) END"
    return f"""WITH d AS (SELECT doc_id, source, md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
  t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), w AS (SELECT *, {pick(WEIGHTS)} AS weight, {pick(SLOPES)} AS slope, ({MOST} * source_size)::DOUBLE AS cap FROM t),
  l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  f AS (SELECT min((cap / weight, level)) FILTER (level <= cap / weight) AS fits FROM l), s AS (SELECT source, source_size, slope, CASE WHEN fits IS NULL THEN cap ELSE least(cap, fits[2] * weight) END AS target FROM l, f),
  r AS (SELECT d.*, source_size, target, slope, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
  p AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM r), k AS (SELECT *, (passes * size + greatest(0, least(size, budget - passes * source_size - start)))::BIGINT AS taken, start / target AS x, (source_size + start) / target AS y, 1 - slope AS rest FROM p)
  SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN {at("x")} END AS position, CASE WHEN taken > size THEN {at("y")} END AS again FROM k"""


def _warc() -> str:
    bit = lambda k: f"(ascii(substr(bits, 5 * i + {k + 1}, 1)) - 48) * {1 << (4 - k)}"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
  q AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + {" + ".join(bit(k) for k in range(5))}, 1)), '') AS payload_digest FROM p), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS ref FROM q)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN ref IS NULL OR page_id = ref THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN ref IS NOT NULL AND (page_id IS NULL OR page_id <> ref) THEN ref END AS refers_to FROM r"""


def _decontamination() -> str:
    words = lambda c: f"regexp_extract_all({LOWER.format(f'coalesce({c}, {chr(39) * 2})')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words("text")} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {words("text")} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  dw AS (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  m AS (SELECT row, i, n, item_id FROM dw JOIN iw USING (n, win)), h AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS spot FROM m) GROUP BY row),
  c AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m GROUP BY row)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (row) LEFT JOIN c USING (row)"""


def _pii() -> str:
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    each = " UNION ALL ".join(f"SELECT row, {i} AS kind_at, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d" for i, (k, p) in enumerate(patterns.items()))
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    digit = f"substr(reverse({digits}), i + 1, 1)::INT"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: (CASE WHEN i % 2 = 0 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END))) % 10 = 0"
    part = "len(ltrim(x, '0')) <= 3 AND coalesce(nullif(ltrim(x, '0'), ''), '0')::INT <= 255"
    ok = f"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: NOT ({part}))) = 0
    WHEN 'phone' THEN length({digits}) BETWEEN 10 AND 15 ELSE CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END END"""
    listed = lambda kind, keep: f"""string_agg({kind} || ':' || start || ':' || "end", ',' ORDER BY start, kind_at, "end") FILTER ({keep})"""
    counts, letters = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns), r"'\p{L}{3,}'"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), total AS (SELECT count(*)::DOUBLE AS n FROM d),
  k AS ({each}), e AS (SELECT row, kind_at, kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM k WHERE len(m) > 0),
  a AS (SELECT row, kind_at, kind, m[i] AS value, sum(length(g[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]) AS start FROM e WINDOW w AS (PARTITION BY row, kind_at ORDER BY i)),
  b AS (SELECT row, kind_at, kind, value, start::BIGINT AS start, (start + length(value))::BIGINT AS "end" FROM a WHERE {ok}),
  w0 AS (SELECT row, regexp_extract_all(text, {letters}) AS m, string_split_regex(text, {letters}) AS g FROM d WHERE row IN (SELECT row FROM b)), w1 AS (SELECT row, m, g, unnest(range(1, len(m) + 1)) AS i FROM w0),
  o AS (SELECT row, lower(m[i]) AS word, (sum(length(g[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]))::BIGINT AS start, length(m[i]) AS size FROM w1 WINDOW w AS (PARTITION BY row ORDER BY i)),
  ent AS (SELECT DISTINCT row, kind || ':' || lower(value) AS entity FROM b), ne AS (SELECT entity, count(*) AS n_e FROM ent GROUP BY entity), cw AS (SELECT DISTINCT row, word FROM o),
  wd AS (SELECT word, count(*) AS n_t FROM (SELECT DISTINCT row, lower(x) AS word FROM (SELECT row, unnest(regexp_extract_all(text, {letters})) AS x FROM d)) GROUP BY word),
  pairs AS (SELECT entity, word, count(*) AS n_et FROM ent JOIN cw USING (row) GROUP BY ALL),
  leaks AS (SELECT entity, word, round(log2((n_et + n_t / n) / (n_e + 1) * n / n_t) / log2(n / n_e), 9) AS share FROM pairs JOIN ne USING (entity) JOIN wd USING (word), total WHERE n_e < n),
  most AS (SELECT row, word, max(share) AS share FROM ent JOIN cw USING (row) JOIN leaks USING (entity, word) GROUP BY row, word HAVING max(share) >= {pii.GENERALISE}),
  terms AS (SELECT row, start, start + size AS stop, CASE WHEN share >= {pii.REMOVE} THEN 'removed' ELSE 'generalised' END AS action FROM o JOIN most USING (row, word)
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.row = o.row AND b.start < o.start + size AND o.start < b."end")),
  every AS (SELECT row, start, kind_at, "end", kind, NULL AS action FROM b UNION ALL SELECT row, start, 4, stop, 'term', action FROM terms),
  s AS (SELECT row, {listed("kind", "true")} AS spans, {listed("kind", "kind_at < 4")} AS base, {listed("action", "kind_at = 4")} AS actions, {counts} FROM every GROUP BY row)
  SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(actions, '') AS actions FROM d LEFT JOIN s USING (row)"""


def _neighbours() -> str:
    """Brute force: where the index has one list, as on small tables, the operator is exact."""
    dot = lambda a, b: f"list_reduce(list_concat([0.0::DOUBLE], list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), lambda x, y: x + y)"
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND {fine}), n AS (SELECT vec_id, v, {dot("v", "v")} AS n FROM e),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, {dot("c.v", "q.v")} / sqrt(c.n * q.n) AS score FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def _urls() -> str:
    host = LOWER.format("coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), '')")
    path = "coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '')"
    rest = LOWER.format("coalesce(regexp_extract(url, '(?s)://[^/?#]*[^?#]*(.*)', 1), '')")
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    return f"""WITH u AS (SELECT page_id, {host} AS host, {path} AS path, {rest} AS rest, row_number() OVER () AS row FROM pages), t AS (SELECT *, {rule} AS rule, {verdict} AS listed,
  list_sort(list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
  list_transform(list_filter(flatten(list_transform(string_split(regexp_replace({LOWER.format("path")}, '[0-9]+', '#', 'g'), '/'), lambda x: string_split(x, '.'))), lambda x: x <> ''), lambda x: 'path:' || x),
  list_transform(regexp_extract_all(rest, '[?&]([^=&#]+)', 1), lambda x: 'query:' || x)))) AS tokens FROM u),
  subs AS (SELECT row, listed, array_to_string(list_filter(tokens, lambda x, i: (mask >> (i - 1)::BIGINT) & 1 = 1), ' ') AS mined, bit_count(mask)::INT AS k FROM (SELECT row, listed, tokens, unnest(range(1, (1::BIGINT << len(tokens)))) AS mask FROM t)),
  total AS (SELECT count(*) AS n FROM t WHERE listed IS NOT NULL), freq AS (SELECT mined, k, count(*) AS f FROM subs WHERE listed IS NOT NULL GROUP BY ALL), hit AS (SELECT mined, listed AS verdict, count(*) AS f FROM subs WHERE listed IS NOT NULL GROUP BY ALL),
  rules AS (SELECT mined, k, verdict, hit.f / freq.f AS confidence, hit.f / n AS support FROM hit JOIN freq USING (mined), total WHERE hit.f >= ceil({SUPPORT} * n) AND hit.f / freq.f >= {CONFIDENCE}),
  best AS (SELECT row, arg_min((rules.mined, verdict), (-confidence, -support, -rules.k, verdict <> 'block', rules.mined)) AS b FROM subs JOIN rules USING (mined) GROUP BY row)
  SELECT page_id, host, path, rule, coalesce(listed, b[2], '{DEFAULT}') AS verdict, CASE WHEN rule IS NULL THEN b[1] END AS mined FROM t LEFT JOIN best USING (row)"""


def _collocations() -> str:
    score = "CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r::HUGEINT) AS BIGINT)"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^.,;:!?\\x0A-\\x0D]+'), lambda x: regexp_extract_all(x, '[^\\x20\\x09]+'))) AS w FROM documents),
  g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
  every AS MATERIALIZED (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM every WHERE k = 1 GROUP BY lang),
  f AS MATERIALIZED (SELECT lang, ph, f, k AS words FROM every WHERE f >= {LEAST}), c AS (SELECT lang, ph AS phrase, f AS a, words, string_split(ph, ' ') AS w FROM f WHERE words > 1),
  parts AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
  cut AS (SELECT parts.*, x.f AS l, y.f AS r FROM parts JOIN f x ON x.lang = parts.lang AND x.ph = head JOIN f y ON y.lang = parts.lang AND y.ph = tail),
  s AS (SELECT *, {score} AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY {score}, k) = 1),
  longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longest FROM c WHERE words = 3), most AS (SELECT lang, phrase, max(longest) AS longest FROM longer GROUP BY ALL),
  o AS (SELECT s.* FROM s LEFT JOIN most USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {PART} * a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN total USING (lang) QUALIFY rank <= {TOP}"""


ORACLE: dict[str, str] = {"op1_url_rules": _urls(), "op5_adaptive_scan_neighbours": _neighbours(), "op2_hash_tree_shards": _shards(), "op3_curriculum_mix": _mix(), "op4_warc_salvage": _warc(), "op8_pii": _pii(), "op10_decontamination": _decontamination(), "op11_collocations": _collocations()}
