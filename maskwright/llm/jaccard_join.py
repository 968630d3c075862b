"""Near-duplicate documents by word shingles: an exact Jaccard self-join over parity sketches.

A document's set is its distinct word shingles as 64-bit hashes. In the size band of a pair, hash space is cut into ``p``
segments and a set's sketch has one 64-bit parity (XOR) per segment. The number of segments in which two sketches differ
is a Hamming distance that never exceeds the symmetric difference ``d`` of the sets. At the wanted similarity ``d`` is at
most ``d_max``; with ``p = d_max + 1 + slack`` segments more than ``slack`` of them agree (pigeonhole), so joining on
single segments finds every pair. Segments with fewer than two hashes prove little: a set with at most ``slack`` of them
drops them all, so some agreeing segment of the pair is emitted by both; a set with more drops only half of ``slack``, so
two such sets together drop fewer than the segments they agree on.

Equal sets are merged first. Sets with a common segment are joined to one of them as a star, which tasks begin before
the shuffle, so that a hot segment shrinks to a row per batch. Star pairs are verified on the whole texts and merged.
Segments that then still hold several components compare those in blocks, by size and by the Hamming distance of one-bit
parity sketches: first the nearest pairs that would join them are verified, then all that are left between different
components, so no link between components is lost.

Defined cases: null or empty texts have no set, link with nothing and are their own component; fewer words than a
shingle make one shingle; equal texts share a component; rows that share an id are one document; null ids link with
nothing; very long texts are worked on one at a time; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import materialise, table, tidy
from maskwright.llm.components import connected_components

#: Defaults of near-duplicate stages: words of a shingle, and the similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Ratio of a size band's ends, its first size, and the bits of the one-bit parity sketch.
BAND, FIRST, BITS = 1.3, 4, 4096
#: Sets of a segment that are compared at once in the second round.
BLOCK = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a run."""
    low = B.LOWER[data]
    begin, end, before = B.words(low, offsets, B.NOT_SPACE)
    h = B.span_hashes(low, begin, end)
    grams = B.gram_hashes(h, shingle)
    out = []
    for x, y in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if y - x >= shingle:
            out.append(np.unique(grams[x : y - shingle + 1]))
        else:
            out.append(B.gram_hashes(h[x:y], y - x) if y > x else np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands of pairs, by the lesser size: how many segments each needs."""

    def __init__(self, percent: int):
        self.t = percent / 100

    def of(self, n: int) -> int:
        return max(0, int(math.floor(math.log(max(n, FIRST) / FIRST) / math.log(BAND) + 1e-9)))

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, slack)"""
        most = math.ceil(FIRST * BAND ** (band + 1)) + 1
        d = int(most * (1 + 1 / self.t) * (1 - self.t) / (1 + self.t) + 1e-9)
        slack = 2 + d // 4
        return d + 1 + slack, slack

    def emitted(self, n: int) -> list[int]:
        """Every band that the lesser size of a pair with this set can lie in."""
        return list(range(self.of(math.floor(self.t * n - 1e-9)), self.of(n) + 1))


def segment_keys(u: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of one set (sorted hashes): a hash of (band, segment, parity)."""
    n, out = len(u), []
    if not n:
        return np.zeros(0, np.uint64)
    parity = np.zeros(n + 1, np.uint64)
    np.bitwise_xor.accumulate(B.mix(u ^ np.uint64(0x5851F42D4C957F2D)), out=parity[1:])
    top = u >> np.uint64(32)
    for band in bands.emitted(n):
        p, slack = bands.segments(band)
        edge = np.searchsorted((top * np.uint64(p)) >> np.uint64(32), np.arange(p + 1, dtype=np.uint64))
        value = parity[edge[1:]] ^ parity[edge[:-1]]
        filled = np.diff(edge)
        seg = np.arange(p, dtype=np.uint64)
        weak = np.argsort(filled, kind="stable")[: int((filled < 2).sum())]
        drop = weak if len(weak) <= slack else weak[: slack // 2]
        keep = np.ones(p, bool)
        keep[drop] = False
        value, seg = value[keep], seg[keep]
        out.append(B.mix(value + B.mix(seg + np.uint64(band << 32))))
    return np.concatenate(out)


def bit_sketch(u: np.ndarray) -> bytes:
    """BITS parities: each hash toggles one bit."""
    return np.packbits(np.bincount((B.mix(u) >> np.uint64(50)).astype(np.int64) % BITS, minlength=BITS)[:BITS] & 1 == 1).tobytes()


def _features(shingle: int, percent: int, keyed: bool = False, sketched: bool = False):
    def go(batches):
        bands = Bands(percent)
        for batch in batches:
            data, offsets = B.buffers(batch.column(1))
            n, h1, h2, keys, bits = [], [], [], [], []
            for i, j in B.runs(offsets):
                for u in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle):
                    n.append(len(u))
                    h1.append(int(np.bitwise_xor.reduce(u)) if len(u) else 0)
                    h2.append(int(B.mix(u).sum()) if len(u) else 0)
                    if keyed:
                        keys.append(segment_keys(u, bands).view(np.int64))
                    if sketched:
                        bits.append(bit_sketch(u))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            cols, names = [batch.column(0), pa.array(n, pa.int64()), signed(h1), signed(h2)], ["doc_id", "n", "h1", "h2"]
            if keyed:
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("keys")
            if sketched:
                cols.append(pa.array(bits, pa.binary()))
                names.append("bits")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return go


def _star_in_batch(batches):
    """Rows of (set, its keys) to (route, key, node, n, pivot): a batch's sets with a common key meet their least one here.

    Only that one goes on to the other batches' (pivot is null, route is the key); the others are done.
    """
    for batch in batches:
        keys = batch.column("keys")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        count = np.diff(keys.offsets.to_numpy())
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), count)
        size = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), count)
        order = np.lexsort((node, flat))
        k, v, n = flat[order], node[order], size[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        pivot = v[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else v
        apart = new | (v != pivot)  # equal sets meet themselves
        k, v, n, pivot, new = k[apart], v[apart], n[apart], pivot[apart], new[apart]
        route = np.where(new, k, B.mix(k ^ B.mix(v.view(np.uint64))))
        for a in range(0, len(k), 100_000):
            s = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route[s].view(np.int64)), pa.array(k[s].view(np.int64)), pa.array(v[s]), pa.array(n[s]), pa.array(pivot[s], mask=new[s])],
                names=["route", "key", "node", "n", "pivot"],
            )


def _stars_of_texts(shingle: int, percent: int):
    """(doc_id, text) to the rows of ``_star_in_batch``, in one worker: sets without shingles have no keys."""

    def go(batches):
        for batch in _features(shingle, percent, keyed=True)(batches):
            yield from _star_in_batch([pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("n"), batch.column("keys")], names=["node", "n", "keys"])])

    return go


def _star_across(batches):
    """Sorted by (route, key, node): key rows with a common key meet the first one. Gives (key, node, n, pivot) of live keys."""
    held = None  # the last key row, whose key may go on in the next batch
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        done = np.asarray(batch.column("pivot").is_valid())
        pivot = batch.column("pivot").fill_null(0).to_numpy(zero_copy_only=False)
        parts = [(key[done], node[done], n[done], pivot[done])]
        k, v, s = key[~done], node[~done], n[~done]
        if len(k):
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            lead = v[np.flatnonzero(first)][np.cumsum(first) - 1]
            if held is not None and held[0] == k[0]:
                end = int(np.argmax(k != k[0])) if (k != k[0]).any() else len(k)
                lead[:end] = held[1]
                first[0] = False
            same = ~first & (v != lead)
            parts.append((k[same], v[same], s[same], lead[same]))
            if held is None or held[0] != k[-1]:
                held = (k[-1], lead[-1])
        cols = [np.concatenate([p[i] for p in parts]) for i in range(4)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n", "pivot"])


def possible(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and one-bit sketches allow the similarity: their Hamming distance never exceeds the sets' difference."""
    if not len(a):
        return np.zeros(0, bool)
    t = percent / 100
    x, y = (np.frombuffer(b"".join(v), np.uint64).reshape(len(v), BITS // 64) for v in (a, b))
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9) & (apart <= (1 - t) / (1 + t) * (na + nb) + 1e-9)


def _possible(percent: int):
    def go(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            ok = pa.array(possible(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), na, nb, percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return go


def _verify_batches(shingle: int, percent: int):
    def go(batches):
        for batch in batches:
            sets = []
            for column in ("ta", "tb"):
                data, offsets = B.buffers(batch.column(column))
                sets.append([u for i, j in B.runs(offsets) for u in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)])
            ok = []
            for u, v in zip(*sets, strict=True):
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return go


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct whole texts of the given documents; rows that share an id may have several."""
    own = docs.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").withColumn("_h", F.xxhash64("text"))
    return materialise(own.dropDuplicates(["doc_id", "_h"]).drop("_h"), "texts")


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough, as a written table."""
    pairs = materialise(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    side = lambda x: texts.select(F.col("doc_id").alias(f"i{x}"), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), F.col("a") == F.col("ia")).drop("ia").join(side("b"), F.col("b") == F.col("ib")).drop("ib")
    return materialise(both.mapInArrow(tidy(_verify_batches(shingle, percent), lean=True), "a long, b long"), "links")


def _cross_pairs(percent: int, forest: bool):
    """Sorted by cell: pairs of different components in a cell whose sizes and sketches allow the similarity.

    ``forest``: only the nearest of them that would join all components of the cell which can be joined.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        node = np.array([r[1] for r in rows], np.int64)
        comp, n = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.float64)
        side = np.array([r[5] for r in rows])
        bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), BITS // 64)
        t, left, right, dist = percent / 100, [], [], []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) >= t * np.maximum(n[j], n[i]) - 1e-9) & ((side[j] != side[i]) | (side[i] == 2))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                ok = apart <= (1 - t) / (1 + t) * (n[j] + n[i]) + 1e-9
                left.append(np.full(ok.sum(), i))
                right.append(j[ok])
                dist.append(apart[ok] / (n[j[ok]] + n[i]))
        if not left:
            return []
        i, j = np.concatenate(left), np.concatenate(right)
        if forest:
            parent: dict[int, int] = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            chosen = []
            for k in np.argsort(np.concatenate(dist), kind="stable").tolist():
                x, y = root(int(comp[i[k]])), root(int(comp[j[k]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    chosen.append(k)
            i, j = i[chosen], j[chosen]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return list(zip(b.tolist(), a.tolist(), strict=True))

    def go(batches):
        cell, rows = None, []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "comp", "n", "bits", "side")), strict=True):
                if r[0] != cell:
                    found.update(compare(rows) if len(rows) > 1 else ())
                    cell, rows = r[0], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = set(compare(rows)) if len(rows) > 1 else set()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return go


def cells(rows: DataFrame, group: list[str], block: int, node: str = "node") -> DataFrame:
    """Deals rows (with ``size``, their group's) so that each two rows of a group meet in one cell: ``cell``, ``side``.

    A group of at most ``block`` rows is one cell (side 2). A larger one is cut into blocks; each row goes to the cell of
    each pair of its block with another (side 0 or 1: only rows of different sides meet) and to its block's own (side 2).
    """
    s = F.ceil(F.col("size") / F.lit(block)).cast("int")
    b = F.pmod(F.xxhash64(F.col(node)), s).cast("int")
    other = F.explode(F.sequence(F.lit(0), s - 1))
    dealt = rows.withColumn("_s", s).withColumn("_b", b).withColumn("_o", other)
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return dealt.withColumn("cell", F.xxhash64(*group, F.least("_b", "_o"), F.greatest("_b", "_o"))).withColumn("side", side).drop("_s", "_b", "_o")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id (least id reachable by links, itself included)."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = own.filter("doc_id is not null and text is not null")
    shape = "doc_id long, n long, h1 long, h2 long"
    # sets by their hash; the least id names a set from the verification on, so that equal hashes do no harm
    sets = named.mapInArrow(tidy(_features(shingle, percent, sketched=True), lean=True), shape + ", bits binary").filter("n > 0")
    sets = materialise(sets.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits")), "sets")
    # first round: stars around the least set of each key
    routed = named.mapInArrow(tidy(_stars_of_texts(shingle, percent), lean=True), "route long, key long, node long, n long, pivot long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    live = routed.repartition(parts, "route").sortWithinPartitions("route", "key", "node").mapInArrow(tidy(_star_across, lean=True), "key long, node long, n long, pivot long")
    live = materialise(live, "live")
    # of the stars, those whose sizes and sketches allow the similarity
    stars = live.select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    fact = lambda x: sets.select(F.col("h1").alias(f"h{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    both = stars.join(fact("a"), F.col("x") == F.col("ha")).drop("ha").join(fact("b"), F.col("y") == F.col("hb")).drop("hb", "x", "y")
    stars = both.mapInArrow(tidy(_possible(percent), lean=True), "a long, b long").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialise(stars.distinct(), "stars")
    links = verify(stars, named, shingle, percent)
    merged = materialise(connected_components(links), "merged")
    # second round: keys whose sets are still in several components, first joined by forests, then pair by pair
    # near-copies share many keys: of keys with the same sets one stands for all
    h = F.xxhash64("node")
    groups = live.groupBy("key", "pivot").agg(F.bit_xor(h).alias("s1"), F.sum(F.shiftrightunsigned(h, 40)).alias("s2"), F.count("*").alias("c"))
    same = groups.groupBy("key").agg(F.bit_xor("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("c").alias("c"), F.bit_xor(F.xxhash64("pivot")).alias("s3"), F.min("pivot").alias("p"))
    chosen = materialise(same.groupBy("s1", "s2", "s3", "c", "p").agg(F.min("key").alias("_k")).select("_k"), "chosen")
    some = live.join(chosen, F.col("key") == F.col("_k"), "left_semi")
    members = materialise(some.select("key", "node").unionByName(some.select("key", F.col("pivot").alias("node"))).distinct(), "members")
    facts, tested = sets.select(F.col("node").alias("_f"), "n", "bits"), stars
    names = sets.select(F.col("h1").alias("_h"), F.col("node").alias("name"))
    members = members.join(names, F.col("node") == F.col("_h")).select("key", F.col("name").alias("node"))
    for forest in (True, False):
        placed = members.join(merged.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        placed = materialise(placed, "placed")
        open_keys = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select(F.col("key").alias("_k"), "size")
        members = placed.join(materialise(open_keys, "open"), F.col("key") == F.col("_k")).select("key", "node", "comp", "size")
        rows = members.join(facts, F.col("node") == F.col("_f")).select("key", "node", "comp", "n", "bits", "size")
        dealt = cells(rows, ["key"], BLOCK).repartition(parts, "cell").sortWithinPartitions("cell", "node").select("cell", "node", "comp", "n", "bits", "side")
        more = dealt.mapInArrow(tidy(_cross_pairs(percent, forest), lean=True), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        more = materialise(more, "more")
        tested = tested.unionByName(more)
        links = links.unionByName(verify(more, named, shingle, percent))
        merged = materialise(connected_components(links), "merged")
        members = members.select("key", "node")
    known = sets.join(merged.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("n", "h1", "h2", F.coalesce("component", "node").alias("component_id"))
    known = materialise(known, "known").withColumnsRenamed({"n": "_a", "h1": "_b", "h2": "_c"})
    small = own.mapInArrow(tidy(_features(shingle, percent), lean=True), shape)
    out = small.join(known, (F.col("n") == F.col("_a")) & (F.col("h1") == F.col("_b")) & (F.col("h2") == F.col("_c")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM l
  UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
