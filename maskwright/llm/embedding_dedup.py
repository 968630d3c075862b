"""Near-duplicate vectors of one label: random-hyperplane sign hashing in several tables, exact cosine, components.

A vector's signature in a table is the signs of its products with random hyperplanes. Vectors of one label that share a
signature in any table are compared exactly in double precision. Vectors within half the allowed angle of a common pivot
are linked to each other by the triangle inequality (a ball): they are counted, not compared. Balls that meet in a
bucket are compared in cells of bounded size; each pair counts in the first table that both share, and a cell gives
counts per vector and a forest over its balls, never pairs of either.

With the default 14 planes and 20 tables a pair at cosine 0.98 is missed with probability 0.00004 (an angle of 0.2003
flips a sign with probability 0.0638), closer pairs less often.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without label link
with nothing and are kept; vectors of different lengths link with nothing; equal vectors are linked; rows that share an
id are treated row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise, table, tidy
from maskwright.llm.components import connected_components
from maskwright.llm.jaccard_join import cells

COSINE, PLANES, TABLES, SEED = 0.98, 14, 20, 7
#: Vectors that are compared at once, and slack of the half-angle test.
BLOCK, SLACK = 1500, 1e-6


def _planes(dim: int, planes: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, planes * tables))


def _signatures(planes: int, tables: int, seed: int):
    """(vec_id, label, embedding) to (vec_id, label, unit, sigs): unit vectors as bytes of doubles, null if invalid."""

    def go(batches):
        weights: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(2)
            vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
            ends = vectors.offsets.to_numpy()
            flat = vectors.values.cast(pa.float64())
            bad = np.asarray(flat.is_null())
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            alive = np.asarray(vectors.is_valid())
            unit: list[bytes | None] = [None] * len(vectors)
            sigs: list[bytes | None] = [None] * len(vectors)
            dims = np.diff(ends)
            for dim in np.unique(dims[alive & (dims > 0)]).tolist():
                at = np.flatnonzero(alive & (dims == dim))
                pick = ends[at][:, None] + np.arange(dim)
                v, wrong = x[pick], bad[pick].any(1)
                wrong |= ~np.isfinite(v).all(1)
                v = np.where(wrong[:, None], 0, v)
                v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(float).tiny)
                norm = np.sqrt((v * v).sum(1))
                ok = norm > 0
                v = v[ok] / norm[ok][:, None]
                w = weights.setdefault(dim, _planes(dim, planes, tables, seed))
                bits = (v @ w >= 0).reshape(len(v), tables, planes)
                s = (bits * (1 << np.arange(planes))).sum(2).astype(np.int32)
                for i, u, g in zip(at[ok].tolist(), v, s, strict=True):
                    unit[i], sigs[i] = u.tobytes(), g.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(sigs, pa.binary())], names=["row", "label", "unit", "sigs"])

    return go


def _near(limit: float):
    """Whether a row's unit vector is within the limit of its pivot's."""

    def go(batches):
        for batch in batches:
            own, pivot = batch.column("unit").to_pylist(), batch.column("pivot_unit").to_pylist()
            dim = [len(a) if p is not None and len(a) == len(p) else 0 for a, p in zip(own, pivot, strict=True)]
            ok = np.zeros(len(own), bool)
            for d in set(dim) - {0}:
                at = [i for i, x in enumerate(dim) if x == d]
                a = np.frombuffer(b"".join(own[i] for i in at)).reshape(len(at), -1)
                b = np.frombuffer(b"".join(pivot[i] for i in at)).reshape(len(at), -1)
                ok[at] = (a * b).sum(1) >= limit
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("pivot").filter(pa.array(ok)) if ok.all() else pa.array([p if k else None for p, k in zip(batch.column("pivot").to_pylist(), ok.tolist(), strict=True)], pa.int64())], names=["row", "pivot"])

    return go


def _count_cells(cosine: float, tables: int):
    """Sorted by cell: (row, links, a, b): links per row; and each ball ``a`` with the least one it reaches in the cell."""

    def compare(rows: list[tuple]) -> tuple[list, list]:
        t = rows[0][1]
        dims = {len(r[4]) for r in rows}
        counts, parent = {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for d in dims:
            own = [r for r in rows if len(r[4]) == d]
            v = np.frombuffer(b"".join(r[4] for r in own)).reshape(len(own), -1)
            sig = np.frombuffer(b"".join(r[5] for r in own), np.int32).reshape(len(own), tables)
            ball, side = np.array([r[3] for r in own]), np.array([r[6] for r in own])
            row = np.array([r[2] for r in own])
            for a in range(0, len(own), 512):
                hit = v[a : a + 512] @ v.T >= cosine
                hit &= ball[a : a + 512, None] != ball
                hit &= (side[a : a + 512, None] != side) | (side[a : a + 512, None] == 2)
                i, j = np.nonzero(hit)
                first = (sig[i + a, :t] != sig[j, :t]).all(1) if t else np.ones(len(i), bool)
                i, j = i[first] + a, j[first]
                for x, n in zip(*np.unique(i, return_counts=True), strict=True):
                    counts[int(row[x])] = counts.get(int(row[x]), 0) + int(n)
                for x, y in np.unique(np.stack([ball[i], ball[j]], 1), axis=0).tolist():
                    x, y = root(x), root(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        return list(counts.items()), [(x, root(x)) for x in list(parent) if x != root(x)]

    def out(rows):
        counts, links = compare(rows) if len(rows) > 1 else ([], [])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _ in counts] + [None] * len(links), pa.int64()), pa.array([n for _, n in counts] + [None] * len(links), pa.int64()),
                pa.array([None] * len(counts) + [a for a, _ in links], pa.int64()), pa.array([None] * len(counts) + [b for _, b in links], pa.int64()),
            ],
            names=["row", "links", "a", "b"],
        )

    def go(batches):
        cell, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "t", "row", "ball", "unit", "sigs", "side")), strict=True):
                if r[0] != cell:
                    if len(rows) > 1:
                        yield out(rows)
                    cell, rows = r[0], []
                rows.append(r)
        yield out(rows)

    return go


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, planes: int = PLANES, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows get their own number, so that repeated ids stay apart; the write makes it last
    base = materialise(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("v")), "vectors")
    shape = "row long, label string, unit binary, sigs binary"
    units = base.filter("label is not null and v is not null").select("row", "label", F.col("v").cast("array<double>").alias("v")).mapInArrow(tidy(_signatures(planes, tables, seed)), shape).filter("unit is not null")
    units = materialise(units, "units")
    # balls: the least row of each bucket of the first table is the pivot of those within half the angle
    first = F.substring("sigs", 1, 4)
    pivots = units.groupBy("label", first.alias("sig"), F.length("unit").alias("d")).agg(F.min("row").alias("pivot"), F.min_by("unit", "row").alias("pivot_unit"), F.count("*").alias("n")).filter("n > 1")
    pivots = materialise(pivots.withColumnsRenamed({"label": "_l", "sig": "_s", "d": "_d"}).drop("n"), "pivots")
    inside = units.join(pivots, (F.col("label") == F.col("_l")) & (first == F.col("_s")) & (F.length("unit") == F.col("_d"))).select("row", "unit", "pivot", "pivot_unit")
    limit = math.cos(math.acos(cosine) / 2 - SLACK)
    balls = materialise(inside.mapInArrow(tidy(_near(limit)), "row long, pivot long").filter("pivot is not null").select(F.col("row").alias("_r"), F.col("pivot").alias("ball")), "balls")
    sized = materialise(balls.groupBy("ball").agg(F.count("*").alias("ball_size")).withColumnRenamed("ball", "_ball"), "sizes")
    known = materialise(units.join(balls, F.col("row") == F.col("_r"), "left").select("row", "label", F.coalesce("ball", "row").alias("ball"), "unit", "sigs"), "known")
    # buckets of each table that hold more than one ball
    four = F.explode(F.expr(f"transform(sequence(0, {tables - 1}), t -> struct(t as t, substring(sigs, t * 4 + 1, 4) as sig))"))
    spread = known.select("row", "label", "ball", F.length("unit").alias("d"), four.alias("x")).select("row", "ball", F.xxhash64("label", "d", "x.t", "x.sig").alias("key"), "x.t")
    buckets = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("ball").alias("x"), F.max("ball").alias("y")).filter("x != y").select(F.col("key").alias("_k"), "size")
    buckets = materialise(buckets, "buckets")
    meet = spread.join(buckets, F.col("key") == F.col("_k")).select("row", "ball", "key", "t", "size")
    dealt = cells(meet, ["key"], BLOCK, "row").select("cell", "t", F.col("row").alias("_r"), "ball", "side")
    full = dealt.join(known.select("row", "unit", "sigs"), F.col("_r") == F.col("row")).select("cell", "t", "row", "ball", "unit", "sigs", "side")
    found = full.repartition(parts, "cell").sortWithinPartitions("cell", "row").mapInArrow(tidy(_count_cells(cosine, tables)), "row long, links long, a long, b long")
    found = materialise(found, "found")
    extra = materialise(found.filter("row is not null").groupBy("row").agg(F.sum("links").alias("links")).withColumnRenamed("row", "_e"), "extra")
    merged = materialise(connected_components(found.filter("a is not null").select("a", "b")).withColumnsRenamed({"node": "_n"}), "merged")
    placed = known.select("row", "ball").join(merged, F.col("ball") == F.col("_n"), "left").select("row", "ball", F.coalesce("component", "ball").alias("component"))
    placed = placed.join(sized, F.col("ball") == F.col("_ball"), "left").join(extra, F.col("row") == F.col("_e"), "left")
    placed = materialise(placed.select(F.col("row").alias("_p"), (F.coalesce("ball_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "placed")
    rows = materialise(base.select("row", "vec_id").join(placed, F.col("row") == F.col("_p"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col("row")).alias("component")), "rows")
    least = materialise(rows.groupBy("component").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("component", "_c"), "least")
    out = rows.join(least, F.col("component") == F.col("_c"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), u AS (SELECT vec_id, label, e FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id != y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM l
  UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other
), c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
