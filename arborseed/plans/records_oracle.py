"""DuckDB SQL for the queries of records.py: an independent statement of the same results."""

from __future__ import annotations

from ..operators.genomes import NIBBLES
from .oracle import BASE, DELTA, GS, LONG, META, RS, SCORES, SITES, TREE, B, G, K, as_signed, base_values, dna, rc
from .oracle import ORACLES as BASE_ORACLES

#: A value rotated by a row's own number of places.
TURN = "CASE WHEN {r} % 64 = 0 THEN {x} ELSE ((({x}) & ((1::UBIGINT << (64 - {r} % 64)) - 1)) << ({r} % 64)) | (({x}) >> (64 - {r} % 64)) END"


def whole_hash(letters: str, place: str) -> str:
    return "bit_xor(" + TURN.format(x=base_values("c", letters), r=f"({place})") + ")"


PART = f"(SELECT p_partkey, {dna('p_name')} AS s FROM part)"
LETTERS_OF_PARTS = f"(SELECT p_partkey, length(s) AS n, i, substr(s, i + 1, 1) AS c FROM (SELECT p_partkey, s, unnest(range(0, length(s))) AS i FROM {PART}))"
READ_LETTERS = f"(SELECT read_id, i, substr(s, i + 1, 1) AS c FROM (SELECT read_id, s, unnest(range(0, length(s))) AS i FROM {B}))"
PHRED = "CASE c WHEN 'A' THEN 20 WHEN 'C' THEN 40 WHEN 'G' THEN 30 ELSE 10 END"
DUST = f"""WITH c AS (SELECT read_id, i, c || lead(c) OVER w || lead(c, 2) OVER w AS x FROM {READ_LETTERS} WINDOW w AS (PARTITION BY read_id ORDER BY i)),
 m AS (SELECT * FROM c WHERE x IS NOT NULL), t AS (SELECT read_id, count(*) AS n FROM m GROUP BY read_id),
 p AS (SELECT a.read_id, b.i AS late, a.i AS early FROM m a JOIN m b ON a.read_id = b.read_id AND a.x = b.x AND a.i < b.i AND b.i - a.i <= 63),
 e AS (SELECT read_id, late AS i, 1 AS v FROM p UNION ALL SELECT read_id, early + 64, -1 FROM p UNION ALL SELECT read_id, i, 0 FROM m),
 s AS (SELECT read_id, i, sum(sum(v)) OVER (PARTITION BY read_id ORDER BY i) AS pairs FROM e GROUP BY read_id, i),
 k AS (SELECT read_id, n, max(pairs) FILTER (i >= 64 AND i < n) AS most, arg_max(pairs, i) FILTER (i < n) AS last FROM s JOIN t USING (read_id) GROUP BY ALL)
 SELECT read_id, round(coalesce(CASE WHEN n > 64 THEN 200.0 * most / (64 * 63) WHEN n >= 2 THEN 200.0 * last / (n * (n - 1)) END, 0), 6)::DOUBLE AS dust FROM (SELECT read_id FROM {B}) LEFT JOIN k USING (read_id)"""
SAMPLES = f"""{BASE}, kp AS (SELECT read_id % 4 AS sample, seed, count(*) AS r FROM rs GROUP BY ALL),
 st AS (SELECT sample, sum(ln(1 + r) ^ 2) AS sq, sum(ln(1 + r)) AS lg, count(*) AS kept FROM kp GROUP BY sample),
 ri AS (SELECT sample, sum(1.0 / n) AS inv FROM kp JOIN (SELECT * FROM n WHERE node = (SELECT min(doc_id) FROM g)) USING (seed) GROUP BY sample),
 ge AS (SELECT node, sum(ln(1 + n) ^ 2) AS ge FROM n GROUP BY node),
 h AS (SELECT sample, node, sum(ln(1 + r) / n) AS raw, sum(ln(1 + r) * ln(1 + n)) AS dot, count(*) AS shared, sum(1.0 / n) AS i1, sum(ln(1 + r)) AS hit FROM n JOIN kp USING (seed) GROUP BY ALL)
 SELECT sample, node, round(raw / sqrt(sq), 6) AS log_raw, round(least(1, dot / (sqrt(sq) * sqrt(ge))), 6) AS log_cosine, round(shared / kept, 6) AS containment,
 round(coalesce(i1 / inv, 0), 6) AS weighted_containment, round(hit / lg, 6) AS log_containment FROM h JOIN ge USING (node) JOIN st USING (sample) LEFT JOIN ri USING (sample)"""
CUSTOMER_TAXA = "SELECT printf('c%08d', c_custkey) AS node_id, c_mktsegment AS taxon FROM customer WHERE c_acctbal > 9000"
GENOMES = f"""WITH b AS (SELECT read_id AS block, s FROM {B}), k AS (SELECT count(*) AS k FROM b),
 nt AS (SELECT printf('n%03d', n_nationkey) AS n, printf('r%03d', n_regionkey) AS r FROM nation),
 up AS (SELECT n AS node, 'root' AS a, 0 AS d FROM nt UNION SELECT n, r, 1 FROM nt UNION SELECT n, n, 2 FROM nt UNION SELECT r, 'root', 0 FROM nt UNION SELECT r, r, 1 FROM nt UNION SELECT 'root', 'root', 0),
 bc AS (SELECT a, block, pos, slot, arg_max(base, ck) AS base FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN printf('r%03d', c_nationkey % 5) ELSE printf('n%03d', c_nationkey) END AS a, c_custkey % k AS block,
   c_custkey * 7 % 60 AS pos, c_custkey % 3 AS slot, 'ACGT-'[c_custkey % 5 + 1] AS base, c_custkey AS ck FROM customer, k) GROUP BY ALL),
 sc AS (SELECT a, block, arg_max(x, sk) AS x FROM (SELECT printf('n%03d', s_nationkey) AS a, s_suppkey % k AS block, {{'p': s_suppkey % 3 <> 0, 'i': s_suppkey % 2 = 0}} AS x, s_suppkey AS sk FROM supplier, k) GROUP BY ALL),
 st AS (SELECT node, block, arg_max(x, d) AS x FROM up JOIN sc USING (a) GROUP BY ALL),
 lb AS (SELECT node, block, pos, slot, arg_max(base, d) AS base FROM up JOIN bc USING (a) GROUP BY ALL),
 pl AS (SELECT block, unnest(range(0, greatest(length(s), 60))) AS pos, s FROM b),
 ls AS (SELECT node, block, pos, slot, base FROM lb UNION ALL SELECT n.node, pl.block, pl.pos, 0, substr(s, pl.pos + 1, 1) FROM pl, (SELECT DISTINCT node FROM up) n WHERE pl.pos < length(s)
   AND NOT EXISTS (SELECT 1 FROM lb WHERE lb.node = n.node AND lb.block = pl.block AND lb.pos = pl.pos AND lb.slot = 0)),
 w AS (SELECT node, block, coalesce(string_agg(replace(base, '-', ''), '' ORDER BY pos, CASE WHEN slot = 0 THEN 99 ELSE slot END), '') AS s FROM ls GROUP BY ALL),
 o AS (SELECT node, block, CASE WHEN coalesce(x.i, false) THEN {rc('s')} ELSE s END AS s FROM w LEFT JOIN st USING (node, block) WHERE coalesce(x.p, true))
 SELECT node, md5(coalesce(string_agg(s, '' ORDER BY block), '')) AS h, length(coalesce(string_agg(s, '' ORDER BY block), '')) AS n FROM o GROUP BY node"""
RUNS = "(SELECT l_suppkey, l_orderkey % 1000 AS beg, (l_orderkey % 1000 + l_quantity)::BIGINT AS stop FROM lineitem)"
MERGED = """m AS (SELECT *, max(stop) OVER (PARTITION BY l_suppkey ORDER BY beg, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {x}),
 gr AS (SELECT *, sum(CASE WHEN reach IS NULL OR beg > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY beg, stop ROWS UNBOUNDED PRECEDING) AS q FROM m),
 gap AS (SELECT l_suppkey, min(beg) AS beg, max(stop) AS stop FROM gr GROUP BY l_suppkey, q)"""
VCF = SITES + """, v AS (SELECT site, [qA::BIGINT, qC::BIGINT, qG::BIGINT, qT::BIGINT] AS ad FROM q), f AS (SELECT site, ad, list_max(ad) AS best, CASE WHEN list_max(ad) > 0 THEN list_position(ad, list_max(ad)) - 1 END AS gt, list_sum(ad)::BIGINT AS depth FROM v)"""
PLAIN = "FROM f WHERE gt > 0 AND (site % 7 = 0 OR best >= 40) AND depth >= 5 AND best * 2 > depth"
HEX7 = "('0x' || substr(md5({x}), 1, 7))::BIGINT"
LEAVES = "md5('1:' || {x})"

ORACLES: dict[str, str] = {
    "sequence_hashes": f"SELECT p.p_partkey, coalesce({as_signed('f')}, 0) AS fwd, coalesce({as_signed('r')}, 0) AS rev FROM {PART} p LEFT JOIN (SELECT p_partkey, {whole_hash('ACGT', 'n - 1 - i')} AS f, {whole_hash('TGCA', 'i')} AS r FROM {LETTERS_OF_PARTS} GROUP BY p_partkey) USING (p_partkey)",
    "dust_of_reads": DUST,
    "seed_quality": f"WITH q AS (SELECT read_id, i AS pos0, sum({PHRED}) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING) AS v FROM {READ_LETTERS}) SELECT read_id, count(*) AS n FROM {RS} JOIN q USING (read_id, pos0) WHERE v >= 26 * {K} GROUP BY read_id",
    "early_discard": f"{BASE}, h AS (SELECT read_id, count(*) FILTER (seed IN (SELECT seed FROM n)) AS held, count(*) AS a FROM rs GROUP BY read_id) SELECT read_id, held AS n FROM h WHERE held >= floor(a * 0.1) AND held > 0",
    "discard_by_held_seeds": f"{META}, h AS (SELECT read_id, count(*) AS held FROM rs WHERE seed IN (SELECT seed FROM n) GROUP BY read_id) SELECT read_id, max_score FROM mx JOIN h USING (read_id) WHERE max_score > 0 AND max_score >= floor(held * 0.9)",
    "chain_scores": f"""{BASE}, d AS (SELECT doc_id AS node, pos0 AS r, seed, rev, row_number() OVER (PARTITION BY doc_id ORDER BY pos0) - 1 AS j FROM gs), x AS (SELECT read_id, pos0 AS q, seed, rev, row_number() OVER (PARTITION BY read_id ORDER BY pos0) - 1 AS i FROM rs),
      o AS (SELECT node, seed, min(j) AS j, min(r) AS r, bool_or(rev) AS nr FROM d WHERE seed IN (SELECT seed FROM x) GROUP BY node, seed HAVING count(*) = 1), h AS (SELECT read_id, node, i, j, q, r, rev <> nr AS t, CASE WHEN rev <> nr THEN j + i ELSE j - i END AS l FROM x JOIN o USING (seed)),
      u AS (SELECT *, i - row_number() OVER (PARTITION BY read_id, node, t, l ORDER BY i) AS z FROM h), c AS (SELECT read_id, node, t, count(*) AS n, min(i) AS i, min(q) AS q0, max(q) + {K - 1} AS q1, min(r) AS r0, max(r) + {K - 1} AS r1 FROM u GROUP BY read_id, node, t, l, z),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, node ORDER BY n DESC, i) AS p FROM c) WHERE p = 1),
      y AS (SELECT c.read_id, c.node, c.n, c.t, c.i = b.i AS self, c.i < b.i AS early, c.q0 AS cq0, c.q1 AS cq1, c.r0 AS cr0, c.r1 AS cr1, b.q0 AS bq0, b.q1 AS bq1, b.r0 AS br0, b.r1 AS br1 FROM c JOIN b ON c.read_id = b.read_id AND c.node = b.node AND c.t = b.t),
      v AS (SELECT *, CASE WHEN early THEN abs(bq0 - cq1) ELSE abs(cq0 - bq1) END AS g, CASE WHEN early <> t THEN cr0 < br0 ELSE br0 < cr0 END AS ok, CASE WHEN NOT t AND early THEN abs(br0 - cr1) WHEN NOT t THEN abs(cr0 - br1) WHEN early THEN abs(cr0 - br1) ELSE abs(br0 - cr1) END AS rg FROM y)
      SELECT read_id, node, sum(n)::BIGINT AS score FROM v WHERE self OR (ok AND abs(g - rg) < 50) GROUP BY read_id, node""",
    "sam_lines": f"""WITH q AS (SELECT read_id, s, translate(s, 'ACGT', '5I?+') AS ql FROM {B} WHERE length(s) >= 30), p AS (SELECT a.read_id, least(length(a.s), length(b.s)) AS n, a.s, a.ql, b.s AS rf FROM q a JOIN q b ON a.read_id = b.read_id + 1),
      x AS (SELECT read_id, n, read_id % 3 = 0 AS rev, substr(rf, 1, n) AS t, CASE WHEN read_id % 3 = 0 THEN {rc('substr(s, 1, n)')} ELSE substr(s, 1, n) END AS o, CASE WHEN read_id % 3 = 0 THEN reverse(substr(ql, 1, n)) ELSE substr(ql, 1, n) END AS w FROM p),
      m AS (SELECT read_id, i, substr(t, i, 1) AS c FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM x) WHERE substr(o, i, 1) <> substr(t, i, 1)), g AS (SELECT *, i - 1 - coalesce(lag(i) OVER (PARTITION BY read_id ORDER BY i), 0) AS run FROM m),
      d AS (SELECT read_id, string_agg(run || c, '' ORDER BY i) AS md, max(i) AS last FROM g GROUP BY read_id)
      SELECT array_to_string(['r' || read_id, CASE WHEN rev THEN '16' ELSE '0' END, 'ref', (read_id * 10 + 1)::VARCHAR, '60', n || 'M', '*', '0', '0', o, w, 'MD:Z:' || coalesce(md, '') || (n - coalesce(last, 0))], chr(9)) AS value FROM x LEFT JOIN d USING (read_id)""",
    "sketch_dedup_by_gaps": f"SELECT count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, string_agg((pos0 - p0) || ':' || seed || ':' || rev::INT, ',' ORDER BY pos0) AS k FROM (SELECT *, min(pos0) OVER (PARTITION BY doc_id) AS p0 FROM {GS}) GROUP BY doc_id) GROUP BY k",
    "sample_scores": SAMPLES,
    "subtree_taxa": f"{TREE}, x AS (SELECT up.ancestor AS node, list_sort(list(DISTINCT taxon)) AS t FROM up JOIN ({CUSTOMER_TAXA}) USING (node_id) GROUP BY up.ancestor) SELECT node, CASE WHEN len(t) > 3 THEN '' ELSE array_to_string(t, ',') END AS taxa, len(t) > 3 AS over FROM x",
    "poisoned_reads": f"{META}, o AS (SELECT source FROM (SELECT DISTINCT node FROM a) JOIN g ON node = doc_id GROUP BY source HAVING count(*) > 3), bad AS (SELECT read_id FROM a JOIN g ON node = doc_id WHERE source IN (SELECT source FROM o)) SELECT read_id, count(*) AS nodes FROM a WHERE read_id NOT IN (SELECT read_id FROM bad) GROUP BY read_id",
    "collapse_scoring": f"{TREE}, c AS (SELECT printf('c%08d', c_custkey) AS x FROM customer WHERE c_custkey % 3 = 0 UNION SELECT printf('n%03d', n_nationkey) FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'root') SELECT node_id, arg_max(ancestor, ancestor_depth) AS keeper FROM up WHERE ancestor IN (SELECT x FROM c) GROUP BY node_id",
    "orientation_changes": f"{BASE}, mp AS (SELECT source, min(doc_id) AS parent FROM g GROUP BY source), u AS (SELECT doc_id AS node, parent FROM g JOIN mp USING (source) WHERE doc_id <> parent), s AS (SELECT u.node, seed, n_fwd AS f, n_rev AS v FROM u JOIN n USING (node) UNION ALL SELECT u.node, seed, -n_fwd, -n_rev FROM u JOIN n ON n.node = u.parent), z AS (SELECT node, seed, sum(f) AS f, sum(v) AS v FROM s GROUP BY ALL) SELECT node, count(*) AS changes, sum(f)::BIGINT AS fwd, sum(v)::BIGINT AS rev FROM z WHERE f <> 0 OR v <> 0 GROUP BY node",
    "node_genomes": GENOMES,
    "decoded_bases": "SELECT o_orderkey, " + " || ".join(f"substr('{NIBBLES}', (o_orderkey::HUGEINT * 2654435761 % 16777216 // {16 ** (5 - i)} % 16)::INT + 1, 1)" for i in range(6)) + " AS bases FROM orders",
    "imputed_changes": "SELECT a AS base_from, b AS base_to, count(*) AS n FROM (SELECT 'ACGTN'[l_suppkey % 5 + 1] AS a, 'ACGTRYN-'[l_partkey % 8 + 1] AS b FROM lineitem) WHERE NOT (a <> 'N' AND b IN ('R', 'Y', 'N')) GROUP BY ALL",
    "strand_mirror": "SELECT l_suppkey, sum(y)::BIGINT AS total, max(y)::BIGINT AS most FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 113 - (l_partkey % 100 + 7) ELSE l_partkey % 100 + 7 END AS y FROM lineitem) GROUP BY l_suppkey",
    "regapped_places": f"WITH {MERGED.format(x=f'(SELECT * FROM {RUNS} WHERE stop - beg < 6)')}, z AS (SELECT *, coalesce(sum(stop - beg + 1) OVER (PARTITION BY l_suppkey ORDER BY beg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gap), p AS (SELECT DISTINCT l_suppkey, l_partkey % 500 AS x FROM lineitem) SELECT l_suppkey, x, (x + coalesce((SELECT sum(stop - beg + 1) FROM z WHERE z.l_suppkey = p.l_suppkey AND z.beg - z.before <= p.x), 0))::BIGINT AS regapped FROM p",
    "subtracted_intervals": f"WITH r AS (SELECT DISTINCT l_suppkey, unnest(range(beg, stop + 1)) AS x FROM {RUNS} WHERE l_suppkey % 2 = 0), c AS (SELECT DISTINCT l_suppkey, unnest(range(l_partkey % 1000, l_partkey % 1000 + l_linenumber + 1)) AS x FROM lineitem), o AS (SELECT l_suppkey, x, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS q FROM (FROM r EXCEPT FROM c)) SELECT l_suppkey, min(x)::BIGINT AS beg, max(x)::BIGINT AS stop FROM o GROUP BY l_suppkey, q",
    "inverted_intervals": f"SELECT l_suppkey, min(1100 - stop)::BIGINT AS least, max(1100 - beg)::BIGINT AS most, sum(stop - beg)::BIGINT AS total FROM {RUNS} GROUP BY l_suppkey",
    "flank_mask": f"WITH r AS (SELECT read_id, i + 1 AS pos, (i + 1) % 7 <> 0 AS real FROM {READ_LETTERS}), c AS (SELECT *, count(*) FILTER (real) OVER (PARTITION BY read_id ORDER BY pos) AS l, count(*) FILTER (real) OVER (PARTITION BY read_id ORDER BY pos DESC) AS z FROM r) SELECT read_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM c WHERE l > 10 AND z > 10 GROUP BY read_id",
    "simulated_changes": f"WITH t AS (SELECT doc_id, s, CASE WHEN length(s) > 2000 THEN 1000 ELSE 0 END AS fl, unnest(range(0, 32)) AS try FROM {G} WHERE length(s) > 0), d AS (SELECT *, {HEX7.format(x="'1:' || doc_id || ':' || try")} AS draw FROM t), p AS (SELECT *, fl + draw % (length(s) - 2 * fl) AS pos FROM d), f AS (SELECT doc_id, pos, min(try) AS try, arg_min(draw, try) AS draw, any_value(substr(s, pos + 1, 1)) AS ref FROM p GROUP BY doc_id, pos), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY try) AS i FROM f) SELECT doc_id, pos::BIGINT AS pos, ref, 'ACGT'[(instr('ACGT', ref) + draw % 3) % 4 + 1] AS alt FROM k WHERE i <= 8",
    "sampled_leaves": f"{TREE} SELECT node_id FROM num WHERE is_leaf ORDER BY {LEAVES.format(x='node_id')}, node_id LIMIT 20",
    "median_length": f"WITH t AS (SELECT length(s) AS l FROM (SELECT * FROM {G} ORDER BY {LEAVES.format(x='doc_id')}, doc_id LIMIT 10)) SELECT list_sort(list(l))[count(*) // 2 + 1] AS median FROM t",
    "haploid_likelihoods": f"""WITH o AS (SELECT read_id + 1 + i AS pos, c, {PHRED} AS q FROM {READ_LETTERS} WHERE {PHRED} >= 15), w AS (SELECT pos, c, 10.0 ^ (-q / 10.0) AS e FROM o),
      l AS (SELECT pos, count(*) AS depth, {', '.join(f"count(*) FILTER (c = '{b}') AS n_{b}, sum(CASE WHEN c = '{b}' THEN -10 * log10(1 - e) ELSE -10 * log10(e / 3) END) AS l{b}" for b in 'ACGT')} FROM w GROUP BY pos)
      SELECT pos, depth, n_A, n_C, n_G, n_T, {', '.join(f'round(l{b} - least(lA, lC, lG, lT), 4) AS pl_{b}' for b in 'ACGT')} FROM l""",
    "consensus_indels": f"SELECT doc_id, md5(substr(s, 1, 11) || substr(s, 14, 8) || 'ACG' || substr(s, 22)) AS h FROM {G} WHERE length(s) >= 40",
    "collapse_to_parent": f"{DELTA}, k AS (SELECT DISTINCT node FROM ch) SELECT d AS node_id, CASE WHEN d IN (FROM k) THEN d WHEN so IN (FROM k) THEN so WHEN lang IN (FROM k) THEN lang ELSE 'root' END AS keeper FROM lv",
    "vcf_lines": f"""WITH b AS (SELECT read_id + 1 + i AS pos, c FROM {READ_LETTERS}), n AS (SELECT pos, c, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT pos, sum(n)::BIGINT AS depth, arg_max(c, n * 1000 + ascii(c)) AS alt, max(n) AS support FROM n GROUP BY pos),
      f AS (SELECT s FROM {G} ORDER BY length(s) DESC, doc_id LIMIT 1) SELECT 'first' || chr(9) || pos || chr(9) || '.' || chr(9) || substr(s, pos::INT, 1) || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || '1' AS value
      FROM m, f WHERE pos <= length(s) AND substr(s, pos::INT, 1) <> alt AND support * 2 > depth""",
    "breadth_lines": f"{META}, h AS (SELECT node, seed, count(*) AS d FROM a JOIN (SELECT DISTINCT read_id, seed FROM rs) USING (read_id) JOIN n USING (node, seed) GROUP BY ALL) SELECT node || chr(9) || count(*) || chr(9) || count(d) AS value FROM n LEFT JOIN h USING (node, seed) GROUP BY node",
    "assignment_lines": f"{META} SELECT node || chr(9) || CASE WHEN any_value(lang) = 'en' THEN '.' ELSE any_value(lang) END || chr(9) || count(*) || chr(9) || string_agg(read_id, ',' ORDER BY read_id) AS value FROM a JOIN g ON node = doc_id GROUP BY node",
    "placement_lines": f"{SCORES}, l AS ({LONG}), b AS (SELECT metric, max(score) AS m FROM l GROUP BY metric) SELECT metric || chr(9) || printf('%.6f', max(m)) || chr(9) || string_agg(node, ',' ORDER BY node) AS value FROM l JOIN b USING (metric) WHERE score > 0 AND score >= m - greatest(1e-9, 1e-4 * m) GROUP BY metric",
    "consensus_summary": f"SELECT doc_id, length(s) AS length, (2 * ((length(s) - length(replace(s, 'AAC', ''))) // 3))::BIGINT AS unknown FROM {G}",
    "vcf_fields": f"{VCF} SELECT site AS pos, gt::BIGINT AS gt, CASE WHEN site % 5 = 0 THEN 7 ELSE 4 END::BIGINT AS n_pl, best AS depth, 'CGT' AS alts FROM f",
    "vcf_plain": f"{VCF} SELECT site AS pos, gt::BIGINT AS gt, CASE WHEN site % 7 = 0 THEN '.' ELSE best::VARCHAR END AS qual {PLAIN}",
    "vcf_prior_records": f"""{VCF}, y AS (SELECT *, [300 - ad[1], 306 - ad[2], 309 - ad[3], 312 - ad[4]] AS sc FROM f WHERE site % 11 <> 0), z AS (SELECT *, list_min(sc[2:]) AS m, list_position(sc[2:], list_min(sc[2:])) AS a FROM y)
      SELECT site AS pos, 'CGT'[a] AS alt, (sc[1] - m)::DOUBLE AS qual FROM z WHERE m < sc[1] AND sc[1] - m >= 30 AND depth >= 5 AND ad[a + 1] * 2 > depth
      UNION ALL SELECT site, 'C,G,T', CASE WHEN site % 7 <> 0 THEN best::DOUBLE END FROM f WHERE site % 11 = 0 AND gt > 0""",
    "variant_count": f"{VCF} SELECT count(*) AS variants {PLAIN}",
    "sam_fields": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS a, l_suppkey % 300 AS b, l_quantity > 25 AS rev, l_linenumber % 2 = 0 AS fst, l_quantity::BIGINT AS n FROM lineitem),
      y AS (SELECT *, CASE WHEN rev THEN a + n - 1 ELSE a END AS h, CASE WHEN rev THEN b ELSE b + 39 END AS t, CASE WHEN rev THEN n % 3 ELSE n % 4 END AS c1, CASE WHEN rev THEN n % 4 ELSE n % 3 END AS c2 FROM x)
      SELECT l_orderkey, l_linenumber, (1 + CASE WHEN n > 3 THEN 2 ELSE 0 END + CASE WHEN rev THEN 16 ELSE 32 END + CASE WHEN fst THEN 64 ELSE 128 END)::BIGINT AS flag, (CASE WHEN t > h THEN t - h + 1 WHEN t < h THEN t - h - 1 ELSE 0 END)::BIGINT AS tlen,
      CASE WHEN c1 > 0 THEN c1 || 'S' ELSE '' END || (n + 20 - c1 - c2) || 'M' || CASE WHEN c2 > 0 THEN c2 || 'S' ELSE '' END AS cigar FROM y""",
    "sam_round_trip": f"""WITH q AS (SELECT read_id, s, translate(s, 'ACGT', '5I?+') AS ql FROM {B} WHERE length(s) >= 30), p AS (SELECT a.read_id, least(length(a.s), length(b.s)) AS n, a.s, a.ql FROM q a JOIN q b ON a.read_id = b.read_id + 1)
      SELECT 'r' || read_id AS name, CASE WHEN read_id % 3 = 0 THEN 16 ELSE 0 END::BIGINT AS flag, read_id * 10 AS start, n || 'M' AS cigar, md5(CASE WHEN read_id % 3 = 0 THEN {rc('substr(s, 1, n)')} ELSE substr(s, 1, n) END) AS seq,
      md5(CASE WHEN read_id % 3 = 0 THEN reverse(substr(ql, 1, n)) ELSE substr(ql, 1, n) END) AS qual, read_id % 3 = 0 AS rev, true AS mapped FROM p""",
    "read_groups": f"SELECT read_id, md5(s) AS h FROM {B}",
    "oriented_reads": f"SELECT read_id, md5(CASE WHEN read_id % 2 = 0 THEN {rc('s')} ELSE s END) AS seq, md5(CASE WHEN read_id % 2 = 0 THEN reverse(translate(s, 'ACGT', '5I?+')) ELSE translate(s, 'ACGT', '5I?+') END) AS qual FROM {B}",
    "mismatch_tags": f"""WITH x AS (SELECT a.p_partkey, a.s, b.s AS t, least(length(a.s), length(b.s)) AS n FROM {PART} a JOIN {PART} b ON a.p_partkey = b.p_partkey + 1 WHERE least(length(a.s), length(b.s)) > 0),
      m AS (SELECT p_partkey, n, i, substr(t, i, 1) AS c FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM x) WHERE substr(s, i, 1) <> substr(t, i, 1)),
      g AS (SELECT *, i - 1 - coalesce(lag(i) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS run FROM m)
      SELECT x.p_partkey, coalesce(string_agg(run || c, '' ORDER BY i), '') || (x.n - coalesce(max(i), 0)) AS md FROM x LEFT JOIN g ON g.p_partkey = x.p_partkey GROUP BY x.p_partkey, x.n""",
    "mapped_pairs": "WITH x AS (SELECT l_orderkey AS pair, l_linenumber AS mate, l_quantity::INT - 5 AS score, l_partkey % 60 AS n FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT * FROM x WHERE score > 0 AND score <= n) SELECT pair, mate, score FROM g WHERE pair IN (SELECT pair FROM g GROUP BY pair HAVING count(DISTINCT mate) = 2)",
    "score_lines": f"{SCORES} SELECT node || chr(9) || printf('%.6f', log_raw) || chr(9) || printf('%.6f', log_cosine) || chr(9) || printf('%.6f', containment) || chr(9) || printf('%.6f', log_containment) AS value FROM sc WHERE greatest(log_raw, log_cosine, containment, log_containment) > 0",
    "rank_lines": f"{BASE}, o AS (SELECT node, count(r) / count(*) AS o FROM n LEFT JOIN r USING (seed) GROUP BY node) SELECT (dense_rank() OVER (ORDER BY o DESC) - 1) || chr(9) || node || chr(9) || printf('%.6f', o) AS value FROM o",
    "read_lines": f"{META} SELECT read_id || chr(9) || any_value(seeds) || chr(9) || max_score || chr(9) || count(*) AS value FROM sc JOIN mx USING (read_id) JOIN t USING (read_id) WHERE score = max_score AND max_score > 0 GROUP BY read_id, max_score",
    "frequency_lines": f"WITH c AS (SELECT h, seed, count(*) AS r FROM (SELECT *, (CASE WHEN seed < 0 THEN seed::HUGEINT + 18446744073709551616 ELSE seed END)::UBIGINT AS h FROM {RS}) GROUP BY ALL) SELECT lpad(lower(hex(h)), 16, '0') || chr(9) || r || chr(9) || printf('%.6f', r / (SELECT sum(r) FROM c)) || chr(9) || CASE WHEN seed % 10 = 0 THEN '1' ELSE '0' END AS value FROM c",
    "assigned_fastq": f"{META} SELECT row_number() OVER (ORDER BY read_id) - 1 AS i, '@r' || read_id AS name, md5(s) AS seq, md5(translate(s, 'ACGT', '5I?+')) AS qual FROM (SELECT DISTINCT read_id FROM a) JOIN {B} USING (read_id)",
    "sources_with_reads": f"{META} SELECT source, count(DISTINCT read_id) AS n FROM a JOIN g ON node = doc_id GROUP BY source HAVING count(DISTINCT read_id) >= 2",
    "simulated_reads": f"WITH t AS (SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) < 100 THEN 1 ELSE 5 END)) AS i FROM {G} WHERE length(s) > 0), d AS (SELECT *, {HEX7.format(x="'1:' || doc_id || ':read:' || i")} AS draw FROM t), p AS (SELECT *, draw % greatest(1, length(s) - 99) AS beg, draw // 4096 % 2 = 1 AS rev FROM d), r AS (SELECT *, substr(s, beg + 1, 100) AS x FROM p) SELECT doc_id, i, beg::BIGINT AS \"at\", rev, md5(CASE WHEN rev THEN {rc('x')} ELSE x END) AS h FROM r",
    "dumped_sequences": f"""WITH t AS (SELECT read_id, s, unnest(range(0, 12)) AS try FROM {B} WHERE length(s) > 0), d AS (SELECT *, {HEX7.format(x="'1:' || read_id || ':' || try")} AS draw FROM t), p AS (SELECT *, draw % length(s) AS pos FROM d), f AS (SELECT read_id, pos, min(try) AS try, arg_min(draw, try) AS draw, any_value(substr(s, pos + 1, 1)) AS ref FROM p GROUP BY read_id, pos),
      k AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY try) AS i, 'ACGT'[(instr('ACGT', ref) + draw % 3) % 4 + 1] AS alt FROM f), c AS (SELECT * FROM k WHERE i <= 3),
      l AS (SELECT x.read_id, string_agg(coalesce(alt, x.c), '' ORDER BY x.i) AS s FROM {READ_LETTERS} x LEFT JOIN c ON c.read_id = x.read_id AND c.pos = x.i GROUP BY x.read_id),
      h AS (SELECT read_id, string_agg((pos + 1) || ':' || ref || '>' || alt, ',' ORDER BY pos) AS said FROM c GROUP BY read_id),
      w AS (SELECT read_id, string_agg(substr(s, j * 80 + 1, 80), chr(10) ORDER BY j) AS body FROM (SELECT read_id, s, unnest(range(0, (length(s) + 79) // 80)) AS j FROM l) GROUP BY read_id)
      SELECT md5('>' || read_id || ' changes=' || said || chr(10) || body) AS h, '>' || read_id || ' changes=' || said AS header FROM w JOIN h USING (read_id)""",
    "primer_trimmed": f"WITH x AS (SELECT read_id, s, translate(s, 'ACGT', '5I?+') AS q, length(s) AS n, read_id % 36 AS o FROM {B} WHERE length(s) >= 60), y AS (SELECT *, 5 + CASE WHEN o < 20 THEN o WHEN o < 30 THEN o + 3 WHEN o < 34 THEN 33 ELSE o - 1 END AS a, 5 + (20 + n - 45) - 1 AS b FROM x) SELECT read_id, md5(substr(s, a + 1, b - a)) AS seq, md5(substr(q, a + 1, b - a)) AS qual FROM y",
    "amplicon_stack": f"SELECT primer_id, count(*) AS reads, sum(length(props))::BIGINT AS bases FROM ({BASE_ORACLES['primer_range_join']}) JOIN events ON event_id = read_id GROUP BY primer_id",
    "mixture_index": f"{BASE}, s AS (SELECT 'd' || doc_id AS node, doc_id FROM g UNION ALL SELECT 's' || source, min(doc_id) FROM g GROUP BY source) SELECT s.node, count(*) AS seeds, sum(n_fwd)::BIGINT AS fwd, sum(n_rev)::BIGINT AS rev FROM s JOIN n ON n.node = s.doc_id GROUP BY s.node",
    "forced_placement": f"{SCORES}, l AS ({LONG}) SELECT metric, score, node AS best FROM l WHERE node = 7",
    "lineage_order": f"SELECT lineage, prop, row_number() OVER (ORDER BY prop DESC, lineage) - 1 AS place FROM ({BASE_ORACLES['lineage_rollup']})",
    "amplicon_groups": "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS grp, count(*) AS n FROM customer GROUP BY 1",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_daily": "SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
}
