"""N-gram Jaccard join: components of documents whose shingle sets overlap by a threshold, by rare-first prefix filtering.

Rows of one set are one node. Shingles are ordered rare first, by the corpus counts of their hash buckets, then by hash; a set's
prefix is so long that two linked sets share a prefix shingle. Nodes that share one are compared under length and positional
filters, then under a suffix filter (histograms of the sets by hash range), and the few pairs left are verified on their texts
once per pair. A shingle's nodes are compared with one of them first, the one with the fewest rare shingles; afterwards only pairs across components are
formed, off the pivot's component with all others. No link between components is lost. The pairs formed for a shingle are at most
its nodes times those outside of the pivot's component; they are filtered before any text is fetched, and AQE splits the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hashed, bitmap, buffers, chunks, drop_stash, grams, in_bitmap, mix, stash, summed, text_column, tidy, words

#: Words of a shingle, per cent of the union that linked sets share, buckets of the corpus counts.
N, PERCENT, BUCKETS = 4, 85, 1 << 20
#: Bytes of text that a worker shingles at a time; shingles to a range of a set's histogram, at most.
PASS, TO_RANGE = 1 << 19, 4
SETS = "doc_id long, v long, n long, f1 long, f2 long, bins binary, toks array<long>"
PAIR = ("a", "va", "b", "vb")


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their rows) of a chunk, by row, then hash. A row of fewer than n words is one shingle as a whole."""
    start, end, first = words(data, off)
    h = Hashed(data, fold=True).of(start, end)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    parts, rows = [], []
    for k in range(1, n + 1):
        took = count == k if k < n else count >= n
        if not took.any():
            continue
        mask = took[row]
        g, at = grams(h[mask], np.concatenate([[0], np.cumsum(count[took])]), k)
        parts.append(g)
        rows.append(row[mask][at])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def histograms(g: np.ndarray, r: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each row the numbers of its shingles by range of the hash, a byte each; the longer the set, the more ranges, 2**k.

    A row that a byte can't hold gets none, and no pair of it is filtered.
    """
    bits = np.maximum(3, np.ceil(np.log2(np.maximum(size, 1) / TO_RANGE))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(1 << bits)])
    at = first[:-1][r] + (g >> (64 - bits[r]).astype(np.uint64)).astype(np.int64)
    c = np.bincount(at, minlength=first[-1])
    whole = np.maximum.reduceat(c, first[:-1]) < 256 if len(size) else np.zeros(0, bool)
    kept = np.where(whole, 1 << bits, 0)
    data = c[np.repeat(whole, 1 << bits)].astype(np.uint8)
    off = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data)])


def prefix_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: a hash of its text, the size of its set, a 128-bit fingerprint and histogram of it, its prefix, rare shingles first."""
    text = text_column(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text"))

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, data, off in chunks(batch.column(0), PASS):
            total += np.bincount(bucket(shingle_sets(data, off, n)[0]), minlength=BUCKETS)

    counts = docs.sparkSession.sparkContext.broadcast(summed(rows.select("text"), count, BUCKETS))  # 8 MB by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(2), PASS):
                g, r = shingle_sets(data, off, n)
                size = np.bincount(r, minlength=j - i)
                f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(g):
                    at = (np.cumsum(size) - size)[size > 0]
                    f1[size > 0] = np.add.reduceat(mix(g), at)
                    f2[size > 0] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
                bins = histograms(g, r, size)
                order = np.lexsort((g, counts.value[bucket(g)], r))
                g, r = g[order], r[order]
                place = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
                long = size - (percent * size + 99) // 100 + 1
                in_prefix = place < long[r]
                kept = np.where(size > 0, long, 0)
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(g[in_prefix].view(np.int64)))
                columns = [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bins, toks]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])

    return rows.mapInArrow(tidy(run), SETS)


def may_link(percent: int, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Length and positional filters for two nodes that share the shingles at these places of their orders."""
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return length & ((100 + percent) * F.least(na - pa_, nb - pb) >= percent * (na + nb))


def differences(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """How much two histograms of each pair differ in all, at the coarser one's ranges; 0 where one is missing."""
    out = np.zeros(len(one), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0).tolist():
        if not la or not lb:
            continue
        at, few = np.flatnonzero((size == (la, lb)).all(1)), min(la, lb)
        for s in range(0, len(at), max(1, PASS // max(la, lb))):
            part = at[s : s + max(1, PASS // max(la, lb))]
            x, y = (np.frombuffer(b"".join(side[i] for i in part), np.uint8).reshape(len(part), few, -1).sum(2, dtype=np.int64) for side in (one, two))
            out[part] = np.abs(x - y).sum(1)
    return out


def near(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, va, b, vb) that pass the suffix filter: sets that overlap enough differ little in every partition of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (4, 6))
            need = -(-percent * (na + nb) // (100 + percent))
            ok = differences(batch.column(5).to_pylist(), batch.column(7).to_pylist()) <= na + nb - 2 * need
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in range(4)], list(PAIR))

    one, two = (heads.select(F.col("id").alias(f"{x}_id"), F.col("v").alias(f"{x}_v"), F.col("n").alias(f"{x}_n"), F.col("bins").alias(f"{x}_bins")) for x in "ab")
    rows = pairs.join(one, (F.col("a") == F.col("a_id")) & (F.col("va") == F.col("a_v"))).join(two, (F.col("b") == F.col("b_id")) & (F.col("vb") == F.col("b_v")))
    return rows.select(*PAIR, "a_n", "a_bins", "b_n", "b_bins").mapInArrow(tidy(run), "a long, va long, b long, vb long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs with `linked`: the exact overlap of the two sets. Only texts of the pairs' nodes are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            end = np.cumsum(sum(pc.binary_length(batch.column(k)).to_numpy().astype(np.int64) for k in (4, 5)))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + PASS, "right")))
                (ga, ra), (gb, rb) = (shingle_sets(*buffers(batch.column(k)[i:j]), n) for k in (4, 5))
                na, nb = np.bincount(ra, minlength=j - i), np.bincount(rb, minlength=j - i)
                g, r = np.concatenate([ga, gb]), np.concatenate([ra, rb])
                order = np.lexsort((g, r))
                g, r = g[order], r[order]
                both = np.bincount(r[1:][(g[1:] == g[:-1]) & (r[1:] == r[:-1])], minlength=j - i)
                linked[i:j] = (both >= -(-percent * (na + nb) // (100 + percent))) & (na > 0)
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked)], [*PAIR, "linked"])

    involved = stash(pairs.select(F.col("a").alias("i_id"), F.col("va").alias("i_v")).union(pairs.select("b", "vb")).distinct(), "involved")
    text = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(text_column(docs)).alias("v"), text_column(docs).alias("text"))
    held = split_by(text, "id", involved.select("i_id"))[0].join(involved, (F.col("id") == F.col("i_id")) & (F.col("v") == F.col("i_v")), "left_semi")
    texts = stash(held.groupBy("id", "v").agg(F.first("text").alias("text")), "texts")  # repeated rows meet within their tasks first
    one, two = (texts.select(F.col("id").alias(f"{x}_id"), F.col("v").alias(f"{x}_v"), F.col("text").alias(f"{x}_text")) for x in "ab")
    rows = pairs.join(one, (F.col("a") == F.col("a_id")) & (F.col("va") == F.col("a_v"))).join(two, (F.col("b") == F.col("b_id")) & (F.col("vb") == F.col("b_v")))
    out = stash(rows.select(*PAIR, "a_text", "b_text").mapInArrow(tidy(run), "a long, va long, b long, vb long, linked boolean"), "tested")
    drop_stash(involved, texts)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): the least node that it reaches, by minimum labels and pointer jumping."""
    edges = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = stash(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        labels = roots.select(F.col("node").alias("b"), "root")
        near = edges.join(labels, "b").groupBy("a").agg(F.min("root").alias("best")).withColumnRenamed("a", "node")
        best = roots.join(near, "node").select("node", "root", F.least("root", "best").alias("best"))
        jump = roots.select(F.col("node").alias("best"), F.col("root").alias("far"))
        new = stash(best.join(jump, "best").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
        drop_stash(roots)
        moved = new.where("moved").limit(1).count()
        roots = new
        if not moved:
            drop_stash(edges)
            return roots


def ordered(one: tuple[Column, Column], two: tuple[Column, Column]) -> list[Column]:
    """A pair's columns, the smaller node first."""
    x, y = F.struct(one[0].alias("id"), one[1].alias("v")), F.struct(two[0].alias("id"), two[1].alias("v"))
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["id"].alias("a"), low["v"].alias("va"), high["id"].alias("b"), high["v"].alias("vb")]


def links(postings: DataFrame, heads: DataFrame, docs: DataFrame, n: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the linked ids, from postings (tok, id, v, n, pos) and heads (id, v, n, bins); known: further links (a, b)."""
    # The node with the fewest rare shingles before the shared one is likely the least edited of near copies, so nearest to all others.
    order = (F.col("pos"), F.xxhash64("id", "v").alias("h"))
    pivots = postings.groupBy("tok").agg(F.min(F.struct(*order, "id", "v", "n")).alias("q"), F.count("*").alias("c")).where("c > 1")
    pivots = stash(pivots.select(F.col("tok").alias("p_tok"), *(F.col(f"q.{x}").alias(f"p_{x}") for x in ("id", "v", "n", "pos"))), "pivots")
    fits = may_link(percent, F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos"))
    got = postings.join(pivots, (F.col("tok") == F.col("p_tok")) & (F.col("id") != F.col("p_id")) & fits)
    got = got.select(*ordered((F.col("id"), F.col("v")), (F.col("p_id"), F.col("p_v")))).distinct()
    pairs = stash(near(got, heads, percent), "pairs")
    drop_stash(pivots)
    tested = verified(pairs, docs, n, percent)
    drop_stash(pairs)
    found = tested.where("linked").select("a", "b")
    found = stash(found if known is None else found.union(known), "links")
    roots = components(found)
    # What is left: pairs across components.
    rooted = postings.join(roots.withColumnRenamed("node", "r_id"), F.col("id") == F.col("r_id"), "left").withColumn("root", F.coalesce("root", "id")).drop("r_id")
    rooted = stash(rooted, "rooted")
    mixed = rooted.groupBy("tok").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(*order, "root")).alias("q")).where("low < high")
    mixed = stash(mixed.select(F.col("tok").alias("m_tok"), F.col("q.root").alias("main")), "mixed")
    across = stash(rooted.join(mixed, F.col("tok") == F.col("m_tok")).drop("m_tok"), "across")
    drop_stash(rooted, mixed)
    few = across.where(F.col("root") != F.col("main")).select(*(F.col(c).alias(f"f_{c}") for c in ("tok", "id", "v", "n", "pos", "root")))
    fits = may_link(percent, F.col("n"), F.col("pos"), F.col("f_n"), F.col("f_pos"))
    once = (F.col("root") == F.col("main")) | (F.struct("id", "v") < F.struct("f_id", "f_v"))
    rest = few.join(across, (F.col("tok") == F.col("f_tok")) & (F.col("root") != F.col("f_root")) & once & fits)
    rest = rest.select(*ordered((F.col("id"), F.col("v")), (F.col("f_id"), F.col("f_v")))).distinct()
    seen = tested.select(*(F.col(c).alias(f"s_{c}") for c in PAIR))
    rest = stash(near(rest, heads, percent), "pairs")
    more = verified(rest.join(seen, [F.col(c) == F.col(f"s_{c}") for c in PAIR], "left_anti"), docs, n, percent)
    drop_stash(across, rest, tested)
    out = components(more.where("linked").select("a", "b").union(found))
    drop_stash(roots, more, found)
    return out


def split_by(rows: DataFrame, column: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose column may be among the values, rows for which it surely isn't): only the first need an exact join."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(values.select(F.xxhash64(values.columns[0]))))  # 8 MB

    @F.pandas_udf("boolean")
    def reached(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, x.to_numpy()))

    maybe = F.col(column).isNotNull() & reached(F.xxhash64(column))
    return rows.where(maybe), rows.where(~maybe)


def shared_postings(heads: DataFrame) -> DataFrame:
    """(tok, id, v, n, pos) of the prefix shingles that two or more of heads(id, v, n, toks) have, and of some that one has."""
    shared = heads.select(F.explode("toks").alias("s_tok")).groupBy("s_tok").agg(F.count("*").alias("c")).where("c > 1").select("s_tok")
    held = heads.sparkSession.sparkContext.broadcast(bitmap(shared))  # 8 MB
    names = ["tok", "id", "v", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column(3)
            size = np.diff(toks.offsets.to_numpy())
            values = toks.flatten().to_numpy()
            at = np.flatnonzero(in_bitmap(held.value, values))
            row = np.repeat(np.arange(len(size)), size)[at]
            pos = at - (np.cumsum(size) - size)[row]
            yield pa.RecordBatch.from_arrays([pa.array(values[at]), *(batch.column(k).take(pa.array(row)) for k in range(3)), pa.array(pos.astype(np.int32))], names)

    return stash(heads.select("id", "v", "n", "toks").mapInArrow(tidy(run), "tok long, id long, v long, n long, pos int"), "postings")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles and component_id, the least doc_id that its links reach.

    Null, empty and wordless texts have no shingles and link nothing; rows of one doc_id are one document and share a component,
    whatever their texts, and each row has its own n_shingles; a row without doc_id has a null component and links nothing.
    Repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    sets = stash(prefix_sets(docs, n, percent), "sets")
    key = ["f1", "f2", "n"]
    named = sets.where(F.col("doc_id").isNotNull())
    known = named.where(F.col("n") > 0)
    nodes = stash(known.groupBy(*key).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "nodes")
    # Rows whose set no other row has are nodes as they are; of the others, each set's least row.
    maybe, alone = split_by(known, "f1", nodes.where("rows > 1").select("f1"))
    least = maybe.groupBy(*key).agg(F.min(F.struct("doc_id", "v", "bins", "toks")).alias("m")).select("m.doc_id", "m.v", "n", "m.bins", "m.toks")
    heads = stash(alone.select("doc_id", "v", "n", "bins", "toks").union(least).withColumnRenamed("doc_id", "id"), "heads")
    # Ids with several texts link those texts' nodes.
    several = named.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high").select(F.col("doc_id").alias("m_id"))
    several = stash(several, "several")
    renamed = nodes.select(*(F.col(c).alias(f"k_{c}") for c in key), "id")
    same = [(F.col(c) == F.col(f"k_{c}")) for c in key]
    some = bool(several.limit(1).count())
    own = known.join(several, F.col("doc_id") == F.col("m_id"), "left_semi").join(renamed, same).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct() if some else None
    postings = shared_postings(heads)
    roots = links(postings, heads.drop("toks"), docs, n, percent, own)
    drop_stash(postings, heads, several)
    component = renamed.join(roots, F.col("id") == F.col("node"), "left").select(*(f"k_{c}" for c in key), F.coalesce("root", "id").alias("component"))
    out = sets.select("doc_id", *key).join(component, same, "left")
    if some:
        out = out.join(roots.select(F.col("node").alias("own_id"), F.col("root").alias("own_root")), F.col("doc_id") == F.col("own_id"), "left")
    found = F.coalesce(*([F.col("own_root")] if some else []), F.col("component"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), found).alias("component_id"))


def oracle(docs: str = "documents", words: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for jaccard_components: documents meet at each shingle that they share; labels go along links until none is less."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {words - 2}))) AS i FROM w WHERE len(w) >= {words})
      UNION ALL SELECT DISTINCT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {words - 1}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= {percent} * (x.n + y.n - c.c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS label FROM {docs} UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a WHERE r.label < e.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.label::BIGINT AS component_id FROM {docs} d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(label) AS label FROM r GROUP BY node) m ON m.node = d.doc_id"""
