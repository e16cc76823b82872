"""DuckDB SQL for the queries: an independent statement of the same results."""

from __future__ import annotations

from ..functions.sequence import LETTERS, PATTERN
from ..functions.sketch import NT, homopolymer_hashes
from ..operators.placement import METRICS

K, SMALL, DISCARD, CUT = 15, 8, 0.2, 256
_FROM, _TO = LETTERS + LETTERS.upper(), PATTERN * 2


def dna(x: str) -> str:
    return f"translate(regexp_replace(coalesce({x}, ''), '[^A-Za-z]', '', 'g'), '{_FROM}', '{_TO}')"


def rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


def pieces(rows: str, key: str, more: int = 0) -> str:
    """Pieces of CUT characters and the next `more`; a substring of a long text would be read from its start each time."""
    return f"(SELECT {key}, c * {CUT} AS base0, substr(s, c * {CUT} + 1, {CUT} + {more}) AS piece FROM (SELECT {key}, s, unnest(range(0, length(s) // {CUT} + 1)) AS c FROM {rows}))"


def rol(x: str, r: int) -> str:
    """x, an unsigned 64-bit value, rotated to the left."""
    r %= 64
    return x if not r else f"((({x} & {(1 << 64 - r) - 1}::UBIGINT) << {r}) | ({x} >> {64 - r}))"


def window_hash(x: str, n: int, turned: bool) -> str:
    """The xor of n rotated values in a row, read forwards or, turned, backwards."""
    out = rol(x, 0 if turned else n - 1)
    for j in range(1, n):
        out = f"xor({out}, {rol(f'lead({x}, {j}) OVER w', j if turned else n - 1 - j)})"
    return out


def as_signed(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775808 THEN ({x}::HUGEINT - 18446744073709551616)::BIGINT ELSE {x}::BIGINT END"


def base_values(column: str, letters: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN {NT[o]}::UBIGINT" for c, o in zip("ACGT", letters, strict=True)) + " END"


def hashed(rows: str, key: str, opened: bool = False) -> str:
    """(key, pos0, h unsigned, rev) of the syncmers of the rows' column s."""
    last = K - SMALL
    base = f"(SELECT {key}, base0 + i AS pos0, substr(piece, i + 1, 1) AS c FROM (SELECT {key}, base0, piece, unnest(range(0, length(piece))) AS i FROM {pieces(rows, key)}))"
    values = f"(SELECT {key}, pos0, {base_values('c', 'ACGT')} AS v, {base_values('c', 'TGCA')} AS z FROM {base})"
    windows = f"(SELECT {key}, pos0, {window_hash('v', K, False)} AS f, {window_hash('z', K, True)} AS r, {window_hash('v', SMALL, False)} AS sf, {window_hash('z', SMALL, True)} AS sr FROM {values} WINDOW w AS (PARTITION BY {key} ORDER BY pos0))"
    hit = "sf = mf OR lr = mr" + ("" if opened else " OR lf = mf OR sr = mr")
    return f"""(SELECT {key}, pos0, least(f, r) AS h, r < f AS rev FROM (SELECT {key}, pos0, f, r, sf, sr, lead(sf, {last}) OVER w AS lf, lead(sr, {last}) OVER w AS lr,
      min(sf) OVER v AS mf, min(sr) OVER v AS mr FROM {windows} WINDOW w AS (PARTITION BY {key} ORDER BY pos0), v AS (PARTITION BY {key} ORDER BY pos0 ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING))
      WHERE f IS NOT NULL AND f <> r AND ({hit}))"""


def seeds(rows: str, key: str, opened: bool = False) -> str:
    """(key, pos0, seed, rev) of the rows' column s; the seed is the hash as a signed value."""
    return f"(SELECT {key}, pos0, {as_signed('h')} AS seed, rev FROM {hashed(rows, key, opened)})"


G = f"(SELECT doc_id, lang, source, {dna('text')} AS s FROM documents)"
B = f"(SELECT item_id AS read_id, {dna('text')} AS s FROM benchmark)"
GS, RS = seeds(G, "doc_id"), seeds(B, "read_id")
BASE = f"""WITH g AS MATERIALIZED {G}, gs AS MATERIALIZED {GS}, rs AS MATERIALIZED {RS},
 n AS MATERIALIZED (SELECT doc_id AS node, seed, count(*) AS n, count(*) FILTER (NOT rev) AS n_fwd, count(*) FILTER (rev) AS n_rev FROM gs GROUP BY ALL),
 r AS MATERIALIZED (SELECT seed, count(*) AS r FROM rs GROUP BY seed)"""
SCORES = f"""{BASE}, k AS (SELECT sum(ln(1 + r) ^ 2) AS sq, sum(ln(1 + r)) AS lg, count(*) AS kept FROM r),
 i AS (SELECT coalesce(sum(1.0 / n.n), 0) AS inv FROM r JOIN n USING (seed) WHERE node = (SELECT min(doc_id) FROM g)),
 x AS (SELECT node, sum(CASE WHEN r IS NOT NULL THEN ln(1 + r) / n END) AS raw, sum(CASE WHEN r IS NOT NULL THEN ln(1 + r) * ln(1 + n) END) AS dot, sum(ln(1 + n) ^ 2) AS ge,
  count(r) AS shared, sum(CASE WHEN r IS NOT NULL THEN 1.0 / n END) AS inv1, sum(CASE WHEN r IS NOT NULL THEN ln(1 + r) END) AS hit FROM n LEFT JOIN r USING (seed) GROUP BY node),
 sc AS MATERIALIZED (SELECT node, round(coalesce(raw / sqrt(sq), 0), 6) AS log_raw, round(coalesce(least(1, greatest(0, dot / (sqrt(sq) * sqrt(ge)))), 0), 6) AS log_cosine,
  round(shared / kept, 6) AS containment, round(CASE WHEN inv > 0 THEN coalesce(inv1 / inv, 0) ELSE 0 END, 6) AS weighted_containment, round(coalesce(hit / lg, 0), 6) AS log_containment FROM x, k, i)"""
LONG = " UNION ALL ".join(f"SELECT node, '{m}' AS metric, {m} AS score FROM sc" for m in METRICS)
META = f"""{BASE}, q AS MATERIALIZED (SELECT read_id, seed, count(*) FILTER (NOT rev) AS f, count(*) FILTER (rev) AS v FROM rs GROUP BY ALL),
 t AS (SELECT read_id, count(*) AS seeds FROM rs GROUP BY read_id),
 sc AS MATERIALIZED (SELECT read_id, node, greatest(sum(f * (n_fwd > 0)::INT + v * (n_rev > 0)::INT), sum(v * (n_fwd > 0)::INT + f * (n_rev > 0)::INT))::BIGINT AS score FROM q JOIN n USING (seed) GROUP BY ALL),
 mx AS (SELECT read_id, max(score) AS max_score FROM sc GROUP BY read_id),
 best AS (SELECT read_id, max_score FROM mx JOIN t USING (read_id) WHERE max_score > 0 AND max_score >= floor(seeds * {DISCARD})),
 a AS MATERIALIZED (SELECT read_id, node, score FROM sc JOIN best USING (read_id) WHERE score > 0 AND score >= max_score)"""
TREE = """WITH RECURSIVE e AS (SELECT 'root' AS node_id, NULL AS parent_id UNION ALL SELECT printf('r%03d', r_regionkey), 'root' FROM region
 UNION ALL SELECT printf('n%03d', n_nationkey), printf('r%03d', n_regionkey) FROM nation UNION ALL SELECT printf('c%08d', c_custkey), printf('n%03d', c_nationkey) FROM customer),
 p AS (SELECT node_id, node_id AS path, [node_id] AS parts, 0::BIGINT AS depth FROM e WHERE parent_id IS NULL
 UNION ALL SELECT e.node_id, p.path || '/' || e.node_id, list_append(p.parts, e.node_id), p.depth + 1 FROM e JOIN p ON e.parent_id = p.node_id),
 up AS (SELECT node_id, unnest(parts) AS ancestor, unnest(range(0, len(parts))) AS ancestor_depth FROM p),
 z AS (SELECT ancestor AS node_id, count(*) AS size FROM up GROUP BY ancestor),
 num AS (SELECT node_id, depth, row_number() OVER (ORDER BY path) - 1 AS dfs_index, row_number() OVER (ORDER BY path) - 1 + size AS subtree_end, size = 1 AS is_leaf FROM p JOIN z USING (node_id))"""
DELTA = f"""{BASE}, lv AS (SELECT 'd' || doc_id AS d, lang || '|' || source AS so, lang, doc_id FROM g),
 m AS (SELECT lv.*, seed, n FROM n JOIN lv ON node = doc_id),
 c AS MATERIALIZED (SELECT d AS node, seed, n FROM m UNION ALL
  SELECT so, seed, min(n) FROM m GROUP BY so, seed HAVING count(*) = (SELECT count(*) FROM lv WHERE lv.so = m.so) UNION ALL
  SELECT lang, seed, min(n) FROM m GROUP BY lang, seed HAVING count(*) = (SELECT count(*) FROM lv WHERE lv.lang = m.lang) UNION ALL
  SELECT 'root', seed, min(n) FROM m GROUP BY seed HAVING count(*) = (SELECT count(*) FROM lv)),
 pc AS (SELECT d AS node, so AS parent FROM lv UNION SELECT so, lang FROM lv UNION SELECT lang, 'root' FROM lv),
 ch AS (SELECT coalesce(x.node, y.node) AS node, coalesce(x.seed, y.seed) AS seed, coalesce(y.n, 0) AS pn, coalesce(x.n, 0) AS cn FROM (SELECT pc.node, seed, n FROM pc JOIN c USING (node)) x
  FULL JOIN (SELECT pc.node, seed, n FROM pc JOIN c ON c.node = pc.parent) y ON x.node = y.node AND x.seed = y.seed WHERE coalesce(y.n, 0) <> coalesce(x.n, 0)
  UNION ALL SELECT node, seed, 0, n FROM c WHERE node = 'root')"""
SUMMARY = "count(*) AS n, min(pos0)::BIGINT AS first_at, max(pos0)::BIGINT AS last_at, min(seed) AS least, sum(rev::INT)::BIGINT AS n_rev"
THREE = f"""WITH s AS (SELECT p_partkey, {dna("p_name")} AS s FROM part), c AS (SELECT p_partkey, x, count(*) AS c FROM (SELECT p_partkey, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS x FROM s) GROUP BY ALL),
 d AS (SELECT s.p_partkey, CASE WHEN coalesce(sum(c), 0) < 2 THEN 0.0 ELSE 200.0 * sum(c * (c - 1) // 2) / (sum(c) * (sum(c) - 1)) END AS dust FROM s LEFT JOIN c USING (p_partkey) GROUP BY s.p_partkey)"""
SITES = "WITH q AS (SELECT l_partkey AS site, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (year(l_shipdate) % 4 = {i}), 0) AS q{b}" for i, b in enumerate("ACGT")) + " FROM lineitem GROUP BY l_partkey)"
BASES = f"(SELECT doc_id, base0 + i + 1 AS pos, substr(piece, i + 1, 1) AS base FROM (SELECT doc_id, base0, piece, unnest(range(0, length(piece))) AS i FROM {pieces(G, 'doc_id')}))"
PAIRS = f"WITH b AS MATERIALIZED {BASES}, s AS (SELECT p.base AS base_from, c.base AS base_to, count(*) AS n FROM b p JOIN b c ON p.doc_id + 1 = c.doc_id AND p.pos = c.pos WHERE p.base <> c.base GROUP BY ALL)"
fold = lambda *h: f"xor({rol(f'xor({rol(h[0], K)}, {h[1]})', K)}, {h[2]})"
ids = lambda x: f"string_agg({x}, ',' ORDER BY {x})"

ORACLES: dict[str, str] = {
    "reverse_complements": f"SELECT doc_id, md5({rc('s')}) AS h, length(s) AS n FROM {G}",
    "complements": f"SELECT doc_id, md5(translate(s, 'ACGT', 'TGCA')) AS h FROM {G}",
    "homopolymer_compression": f"SELECT doc_id, md5(coalesce(c, '')) AS h, length(coalesce(c, '')) AS n FROM {G} LEFT JOIN (SELECT doc_id, string_agg(base, '' ORDER BY pos) AS c FROM (SELECT *, lag(base) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {BASES}) WHERE b IS NULL OR b <> base GROUP BY doc_id) USING (doc_id)",
    "end_masks": f"SELECT doc_id, md5(CASE WHEN length(s) > 50 THEN substr(s, 26, length(s) - 50) ELSE '' END) AS h FROM {G}",
    "dust_of_names": f"{THREE} SELECT p_partkey, round(dust, 6) AS dust FROM d",
    "dust_filter": f"{THREE} SELECT p_partkey FROM d WHERE dust <= 5",
    "sanitized_names": "SELECT c_custkey, replace(replace(replace(replace(replace(c_name || '/' || c_mktsegment, '/', '_'), '|', '_'), ' ', '_'), ':', '_'), chr(92), '_') AS name, c_name AS mate FROM customer",
    "phred_scale": "SELECT l_discount, round(CASE WHEN l_discount > 0 THEN -10 * log10(l_discount) ELSE 100 END, 6) AS q, round(10.0 ^ (-l_discount * 10), 6) AS p, count(*) AS n FROM lineitem GROUP BY l_discount",
    "base_indexes": "SELECT event_id, CASE upper(event_type[1]) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN '*' THEN 4 ELSE 5 END::BIGINT AS i FROM events",
    "closed_syncmers": f"SELECT doc_id, {SUMMARY} FROM {GS} GROUP BY doc_id",
    "open_syncmers": f"SELECT doc_id, {SUMMARY} FROM {seeds(G, 'doc_id', True)} GROUP BY doc_id",
    "kminmers_l3": f"SELECT doc_id, count(*) AS n, min(pos0)::BIGINT AS first_at, max(pos0)::BIGINT AS last_at, min({as_signed('least(f, b)')}) AS least, sum((b < f)::INT)::BIGINT AS n_rev FROM (SELECT doc_id, pos0, {fold('h', 'h2', 'h3')} AS f, {fold('h3', 'h2', 'h')} AS b FROM (SELECT doc_id, pos0, h, lead(h) OVER w AS h2, lead(h, 2) OVER w AS h3 FROM {hashed(G, 'doc_id')} WINDOW w AS (PARTITION BY doc_id ORDER BY pos0))) WHERE f IS NOT NULL AND f <> b GROUP BY doc_id",
    "seed_frequencies": f"SELECT r, count(*) AS seeds FROM (SELECT count(*) AS r FROM {GS} GROUP BY seed) GROUP BY r",
    "trimmed_seeds": f"SELECT read_id, count(*) AS n FROM {RS} JOIN (SELECT read_id, length(s) AS len FROM {B}) USING (read_id) WHERE pos0 BETWEEN 10 AND len - 12 - {K} GROUP BY read_id",
    "read_dedup": f"SELECT count(*) AS copies, min(doc_id) AS first_id, {ids('doc_id')} AS ids FROM documents GROUP BY text",
    "sketch_dedup": f"SELECT count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, string_agg(seed || ':' || rev::INT, ',' ORDER BY pos0) AS k FROM {GS} GROUP BY doc_id) GROUP BY k",
    "seeds_without_homopolymers": f"{BASE} SELECT count(*) AS seeds, sum(c)::BIGINT AS total FROM (SELECT seed, count(*) AS c FROM gs GROUP BY seed) WHERE seed NOT IN ({', '.join(map(str, homopolymer_hashes(K)))})",
    "seed_mask_top": f"SELECT count(*) AS seeds, sum(r)::BIGINT AS total, min(seed) AS least FROM (SELECT seed, r, row_number() OVER (ORDER BY r DESC, seed) AS i, count(*) OVER () AS n FROM (SELECT seed, count(*) AS r FROM {GS} GROUP BY seed)) WHERE i > floor(n * 0.001)",
    "min_support_auto": f"WITH c AS MATERIALIZED (SELECT seed, count(*) AS r FROM {GS} GROUP BY seed) SELECT count(*) AS seeds, sum(r)::BIGINT AS total FROM c WHERE r >= (SELECT CASE WHEN avg(r) FILTER (r >= 2) > 3 THEN 2 ELSE 1 END FROM c)",
    "seed_stats": f"SELECT round(sum(ln(1 + r) ^ 2), 6) AS squares, round(sum(ln(1 + r)), 6) AS logs, count(*) AS kept FROM (SELECT count(*) AS r FROM {RS} GROUP BY seed)",
    "seeds_by_read_share": f"{BASE} SELECT " + ", ".join(f"count(*) FILTER (c > t * {p} / 100.0) AS over_{p}" for p in (50, 20, 10, 5, 1)) + " FROM (SELECT count(*) AS c FROM n GROUP BY seed), (SELECT count(*) AS t FROM g)",
    "node_scores": f"{SCORES} SELECT * FROM sc",
    "placement_best": f"{SCORES}, l AS ({LONG}), b AS (SELECT metric, max(score) AS m FROM l GROUP BY metric) SELECT metric, round(max(m), 6) AS score, min(node) AS best, {ids('node')} AS nodes FROM l JOIN b USING (metric) WHERE score > 0 AND score >= m - greatest(1e-9, 1e-4 * m) GROUP BY metric",
    "topk_candidates": f"{SCORES}, l AS ({LONG}) SELECT DISTINCT node FROM (SELECT node, row_number() OVER (PARTITION BY metric ORDER BY score DESC, node DESC) AS i FROM l WHERE score > 0) WHERE i <= (SELECT greatest(1, least(floor(count(*) * 0.01), 150)) FROM sc)",
    "tree_dfs": f"{TREE} SELECT * FROM num",
    "tree_ancestors": f"{TREE} SELECT node_id, ancestor_depth, ancestor FROM up",
    "leaf_only": f"{TREE} SELECT node_id FROM num WHERE is_leaf",
    "common_ancestors": f"{TREE}, m AS (SELECT c_mktsegment || '-' || floor(c_acctbal / 500)::BIGINT AS key, printf('c%08d', c_custkey) AS node_id FROM customer), h AS (SELECT key, ancestor, ancestor_depth, count(*) AS c FROM m JOIN up USING (node_id) GROUP BY ALL) SELECT key, arg_max(ancestor, ancestor_depth) AS lca, max(ancestor_depth) AS lca_depth FROM h JOIN (SELECT key, count(*) AS n FROM m GROUP BY key) USING (key) WHERE c = n GROUP BY key",
    "radius_nodes": f"{TREE}, u AS (SELECT node_id AS x, parent_id AS y FROM e WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, node_id FROM e WHERE parent_id IS NOT NULL), s AS (SELECT n_name AS source, printf('n%03d', n_nationkey) AS x FROM nation), w AS (SELECT source, x, 0 AS d FROM s UNION ALL SELECT source, y, 1 FROM s JOIN u USING (x) UNION ALL SELECT source, b.y, 2 FROM s JOIN u a USING (x) JOIN u b ON a.y = b.x) SELECT source, distance, count(*) AS n FROM (SELECT source, x, min(d)::BIGINT AS distance FROM w GROUP BY ALL) GROUP BY ALL",
    "seed_changes": f"{DELTA} SELECT node, count(*) AS changes, sum(cn)::BIGINT AS child_total, sum(pn)::BIGINT AS parent_total FROM ch GROUP BY node",
    "delta_reconstruct": f"{BASE} SELECT 'd' || node AS node, count(*) AS seeds, sum(n)::BIGINT AS total FROM n GROUP BY node",
    "collapse_identical": f"{BASE} SELECT node, min(node) OVER (PARTITION BY k) AS keeper FROM (SELECT node, string_agg(seed || ':' || n_fwd || ':' || n_rev, ',' ORDER BY seed) AS k FROM n GROUP BY node)",
    "overlap_ranks": f"{BASE}, o AS (SELECT node, count(r) / count(*) AS o FROM n LEFT JOIN r USING (seed) GROUP BY node) SELECT node, round(o, 6) AS overlap, dense_rank() OVER (ORDER BY o DESC) - 1 AS oc_rank FROM o",
    "read_node_score": f"{META} SELECT * FROM sc",
    "read_max_epp": f"{META} SELECT read_id, max_score, count(*) AS epp FROM sc JOIN mx USING (read_id) WHERE score = max_score GROUP BY ALL",
    "mask_seeds": f"{BASE} SELECT doc_id AS read_id, count(*) AS n FROM gs WHERE seed IN (SELECT seed FROM n GROUP BY seed HAVING count(*) > 2) GROUP BY doc_id",
    "mask_reads": f"{BASE}, w AS (SELECT seed FROM n GROUP BY seed HAVING count(*) <= 1) SELECT doc_id AS read_id, count(*) AS n FROM gs WHERE doc_id NOT IN (SELECT doc_id FROM gs JOIN w USING (seed)) GROUP BY doc_id",
    "stream_assign": f"{META} SELECT read_id, node, score FROM a",
    "amplicon_mask": f"{BASE}, o AS (SELECT doc_id, source, seed FROM gs JOIN g USING (doc_id)), w AS (SELECT source, seed, count(DISTINCT doc_id) AS w FROM o GROUP BY ALL), b AS (SELECT source, CASE WHEN source = 'src0' THEN 1 ELSE floor(count(DISTINCT doc_id) * 0.05) END AS b FROM o GROUP BY source) SELECT doc_id AS read_id, count(*) AS n FROM o JOIN w USING (source, seed) JOIN b USING (source) WHERE w > b GROUP BY doc_id",
    "assign_reads": f"{META} SELECT node, count(*) AS n, {ids('read_id')} AS ids FROM a GROUP BY node",
    "ambiguity_band": f"{META} SELECT read_id, count(*) AS nodes, min(node) AS first_node FROM sc JOIN best USING (read_id) WHERE score > 0 AND score >= greatest(0, max_score - 3) GROUP BY read_id",
    "assign_lca": f"{META}, l AS (SELECT read_id, CASE WHEN count(DISTINCT lang) > 1 THEN 'root' WHEN count(DISTINCT source) > 1 THEN min(lang) WHEN count(*) > 1 THEN min(lang || '|' || source) ELSE 'd' || min(node) END AS lca FROM a JOIN g ON node = doc_id GROUP BY read_id) SELECT lca, count(*) AS n, {ids('read_id')} AS ids FROM l GROUP BY lca",
    "taxon_filter": f"{META} SELECT read_id, count(*) AS nodes FROM a JOIN g ON node = doc_id GROUP BY read_id HAVING count(DISTINCT lang) <= 1",
    "breadth_ratio": f"{META}, h AS (SELECT node, seed, count(*) AS d FROM a JOIN (SELECT DISTINCT read_id, seed FROM rs) USING (read_id) JOIN n USING (node, seed) GROUP BY ALL), v AS (SELECT node, count(*) AS total, count(d) AS covered, coalesce(sum(d), 0) AS depth FROM n LEFT JOIN h USING (node, seed) GROUP BY node) SELECT node, total, covered, round(covered / total, 6) AS breadth, round(depth / total, 6) AS mean_depth, round(1 - exp(-depth / total), 6) AS expected, round(CASE WHEN depth > 0 THEN (covered / total) / (1 - exp(-depth / total)) ELSE 0 END, 6) AS ratio FROM v",
    "em_step": f"{META}, p AS (SELECT read_id, node, 0.005 ^ (seeds - score) * 0.995 ^ score AS p FROM sc JOIN best USING (read_id) JOIN t USING (read_id)), z AS (SELECT read_id, sum(p) AS z FROM p GROUP BY read_id) SELECT node, round(sum(p / z) / (SELECT count(*) FROM z WHERE z > 0), 8) AS prop FROM p JOIN z USING (read_id) WHERE z > 0 GROUP BY node",
    "em_loglik": f"{META}, p AS (SELECT read_id, node, 0.005 ^ (seeds - score) * 0.995 ^ score AS p FROM sc JOIN best USING (read_id) JOIN t USING (read_id)) SELECT round(sum(ln(z / (SELECT count(DISTINCT node) FROM p))), 4) AS loglik, count(*) AS reads FROM (SELECT read_id, sum(p) AS z FROM p GROUP BY read_id)",
    "lineage_rollup": "SELECT c_mktsegment AS lineage, round(sum(0.01), 6)::DOUBLE AS prop FROM customer GROUP BY c_mktsegment",
    "spectrum_counts": f"{PAIRS} SELECT * FROM s",
    "spectrum_phred": f"{PAIRS}, k AS (SELECT count(*) AS b, max(length(s)) / 4.0 AS l FROM {G}), o AS (SELECT base_from, base_to, n / (b * l) AS rate FROM s, k UNION ALL SELECT base_from, base_from, 1 - sum(n) / any_value(b * l) FROM s, k GROUP BY base_from) SELECT base_from, base_to, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN -10 * log10(rate) ELSE 100 END, 4) AS phred FROM o",
    "vcf_prior": f"{SITES}, s AS (SELECT site, 300.0 - qA AS a, 306.0 - qC AS c, 309.0 - qG AS g, 312.0 - qT AS t FROM q), b AS (SELECT *, least(c, g, t) AS m FROM s) SELECT site, CASE m WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS alt, round(a - m, 6) AS qual FROM b WHERE m < a AND a - m >= 30",
    "consensus_gate": f"{SITES}, s AS (SELECT site, [qA, qC, qG, qT] AS ad FROM q) SELECT site, (list_position(ad, list_max(ad)) - 1)::BIGINT AS called FROM s WHERE list_position(ad, list_max(ad)) > 1 AND list_sum(ad) >= 10 AND list_max(ad) * 2 > list_sum(ad)",
    "pileup_calls": f"{META}, b AS (SELECT read_id + 1 + i AS pos, substr(s, i + 1, 1) AS base FROM (SELECT read_id, s, unnest(range(0, length(s))) AS i FROM {B})), c AS (SELECT pos, base, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT pos, sum(n)::BIGINT AS depth, arg_max(base, n * 1000 + ascii(base)) AS alt, max(n) AS support FROM c GROUP BY pos) SELECT node, pos, base AS ref, alt, depth, support FROM m JOIN (SELECT doc_id AS node, pos, base FROM {BASES} WHERE doc_id IN (SELECT node FROM a)) USING (pos) WHERE base <> alt AND depth >= 1 AND support * 2 > depth",
    "consensus_build": f"SELECT doc_id, md5(string_agg(CASE WHEN pos % 10 = 0 THEN translate(base, 'ACGT', 'TGCA') ELSE base END, '' ORDER BY pos)) AS h FROM {BASES} GROUP BY doc_id",
    "primer_range_join": "WITH e AS (SELECT event_id AS read_id, event_id * 7 % 1500 AS x, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events), p AS (SELECT n_name AS primer_id, n_nationkey * 50 AS start, n_nationkey * 50 + 80 AS stop, CASE n_nationkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '+' ELSE '-' END AS ps FROM nation) SELECT read_id, arg_min(primer_id, CASE WHEN strand = '-' THEN start ELSE -stop END) AS primer_id FROM e JOIN p ON x BETWEEN start AND stop AND ps IN ('0', strand) GROUP BY read_id",
    "gap_islands": "WITH b AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b), i AS (SELECT user_id, event_type, run, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL) SELECT user_id, event_type, count(*) AS runs, max(n) AS longest, min(first) AS first_id FROM i GROUP BY ALL",
    "coordinate_prefix": "SELECT l_orderkey, max(c)::BIGINT AS last, sum(c)::BIGINT AS total FROM (SELECT l_orderkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM lineitem) GROUP BY l_orderkey",
    "merged_intervals": "WITH x AS (SELECT l_suppkey, l_orderkey % 1000 AS beg, (l_orderkey % 1000 + l_quantity)::BIGINT AS stop FROM lineitem), m AS (SELECT *, max(stop) OVER (PARTITION BY l_suppkey ORDER BY beg, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR beg > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY beg, stop ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_suppkey, min(beg) AS beg, max(stop) AS stop FROM g GROUP BY l_suppkey, g",
    "set_operations": f"{BASE}, b AS (SELECT DISTINCT seed FROM gs) SELECT 'union' AS op, count(*) AS n FROM (SELECT seed FROM r UNION SELECT seed FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT seed FROM r INTERSECT SELECT seed FROM b) UNION ALL SELECT 'only_reads', count(*) FROM (SELECT seed FROM r EXCEPT SELECT seed FROM b)",
}
