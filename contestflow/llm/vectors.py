"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors within cosine c lie within squared distance 2 - 2c. After a rotation that spreads
the energy, a pair within that distance is, in at least one block of coordinates, within the
block's share of it. Each block is range-joined on a grid: a vector stays in its home cell and
visits the greater neighbour cells that its radius touches. What is spread over the cells is an
id and eight coordinates of one byte; only vectors with a candidate there bring their components
to the cell, where candidates are verified exactly. A pair counts only in the first block whose
share it meets, so nothing is counted twice and no pair leaves the task: it returns link counts
and a spanning forest. Equal vectors collapse into one with a multiplicity beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import discard, map_rows, materialize, table, whole_groups
from .graph import components

#: Rows of one cell that meet in a task, as coordinates and as vectors; a larger cell is split
#: into chunks that meet pairwise.
SPREAD_ROWS, CELL_ROWS = 8192, 2048
#: Vectors of one label for which cells use four coordinates of a block; more use more of them.
GRID_VECTORS = 40_000
#: Slack for rounding to 32 bits, relative to the squared distance.
SLACK = 1e-5


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x, f1, f2) of rows that can link: a key, a label, and a vector without nulls,
    NaN or infinity that is not zero. f1 and f2 are 128 bits of hashes of label and vector."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & good)
    prints = [F.xxhash64(F.lit(seed), F.col("label"), F.col("x")).alias(f"f{seed}") for seed in (1, 2)]
    return rows.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), x.alias("x")).select("*", *prints)


def _cells(y: np.ndarray, width: float, radius: float):
    """(row, cell, visits) of one block: home cells, then greater neighbours within the radius.

    Neighbours grow coordinate by coordinate, and those beyond the radius go at once, so the work
    follows what is given out. A neighbour is greater if the first step off the home cell is up.
    """
    home, limit = np.floor(y / width).astype(np.int64), radius**2 * (1 + 1e-9)
    down, up = (y - home * width) ** 2, ((home + 1) * width - y) ** 2
    rows, far, left, cell = np.arange(len(y)), np.zeros(len(y)), np.zeros(len(y), bool), np.empty((len(y), 0), np.int64)
    for k in range(y.shape[1]):
        grown = []
        for step, more in ((0, np.zeros(rows.size)), (1, up[rows, k]), (-1, down[rows, k])):
            pick = np.flatnonzero((far + more <= limit) & (left if step < 0 else True))
            grown.append((rows[pick], far[pick] + more[pick], left[pick] | (step > 0), np.column_stack([cell[pick], home[rows[pick], k] + step])))
        rows, far, left, cell = (np.concatenate(x) for x in zip(*grown, strict=True))
    for visits in (False, True):
        pick = np.flatnonzero(left == visits)
        if pick.size:
            yield rows[pick], cell[pick], visits


def grid_of(vectors: int, block: int = 8) -> int:
    """Coordinates of a block that its cells use, for the vectors of one label: each further one
    parts cells by some two and a half and adds half as many visits, so cells keep their size."""
    return min(block, 4 + max(0, math.ceil(math.log(max(vectors, 1) / GRID_VECTORS, 2.5))))


def _chunked(rows: DataFrame, cell: list[str], most: int) -> DataFrame:
    """Rows of cells with own, left, right: chunks of at most about ``most`` rows meet in pairs."""
    crowded = rows.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*cell, F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    chunked = rows.join(crowded, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return chunked.select("*", other).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("chunks", "other")


def link(prepared: DataFrame, cosine: float = 0.98, block: int = 8, grid: int | None = None) -> DataFrame:
    """(id, n, root): per task and linked vector the number of its links (multiplicities counted)
    and the least id linked.

    ``prepared`` has id (unique), label, dim, x (components as bytes), many. Vectors of different
    length or label never meet. ``block`` is the least number of coordinates in a block, ``grid``
    how many of them the cells use; by default it follows the largest label. It never changes results.
    """
    grid = grid or grid_of(prepared.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0, block)
    budget = 2 - 2 * cosine

    def blocks(dim: int) -> list[np.ndarray]:
        return np.array_split(np.arange(dim), max(1, dim // block))

    def share(dim: int, columns: np.ndarray) -> float:
        return budget * columns.size / dim * (1 + SLACK) + 1e-9

    def step_of(dim: int) -> float:  # of the one-byte coordinates, which are clipped at four deviations
        return min(1.0, 4 / dim**0.5) / 127

    def spread(batch):
        dims, part = batch.column("dim").to_numpy(), batch.column("part").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            z = _turned(batch.column("x").take(pa.array(rows)), dim)
            for b, columns in enumerate(blocks(dim)):
                radius, y = share(dim, columns) ** 0.5, z[:, columns]
                coarse = np.zeros((rows.size, 8), np.int8)
                coarse[:, : columns.size] = np.clip(np.rint(y[:, :8] / step_of(dim)), -127, 127)
                for at, cell, visits in _cells(y[:, :grid], 4 * radius, radius):
                    packed = part[rows[at]].copy()
                    for axis in cell.T:
                        packed = packed * np.int64(0x5851F42D4C957F2D) + axis
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows[at])), pa.array(np.full(at.size, dim, np.int32)), pa.array(np.full(at.size, b, np.int32)), pa.array(packed), pa.array(np.full(at.size, visits)), pa.array(coarse[at].view(np.int64).ravel())],
                        ["id", "dim", "block", "cell", "visits", "y"],
                    )

    cell = ["dim", "block", "cell"]
    part = prepared.select("id", F.xxhash64("label").alias("part"), "dim", "x")
    met = _chunked(map_rows(part, spread, "id long, dim int, block int, cell long, visits boolean, y long"), cell, SPREAD_ROWS)

    def near(batches):
        for table_, edges in whole_groups(batches, [*cell, "left", "right"]):
            ids, own, lefts, rights, dims, blocks_ = (table_.column(c).to_numpy() for c in ("id", "own", "left", "right", "dim", "block"))
            away = table_.column("visits").to_numpy()
            coarse = np.ascontiguousarray(table_.column("y").to_numpy()).view(np.int8).reshape(-1, 8).astype(np.float32)
            found = np.zeros(ids.size, bool)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                dim, columns = int(dims[a]), blocks(int(dims[a]))[blocks_[a]]
                limit = (share(dim, columns) ** 0.5 / step_of(dim) + min(8, columns.size) ** 0.5) ** 2 + 1e-2
                y, id_, visits, mine, hit = coarse[a:b], ids[a:b], away[a:b], own[a:b], found[a:b]
                square = (y * y).sum(1)
                a_rows, b_rows = np.flatnonzero(mine == lefts[a]), np.flatnonzero(mine == rights[a])
                other, side = y[b_rows].T.copy(), visits[b_rows]
                for k in range(0, a_rows.size, 512):
                    rows = a_rows[k : k + 512]
                    i, j = np.nonzero(square[rows, None] + square[None, b_rows] - 2 * (y[rows] @ other) <= limit)
                    good = (id_[rows[i]] != id_[b_rows[j]]) & ~(visits[rows[i]] & side[j])
                    hit[rows[i[good]]] = hit[b_rows[j[good]]] = True
            yield from table_.filter(pa.array(found)).select(["id", *cell, "visits"]).to_batches()

    order = [*cell, "left", "right"]
    flagged = met.repartition(*order).sortWithinPartitions(*order).mapInArrow(near, "id long, dim int, block int, cell long, visits boolean")
    flagged = materialize(flagged.distinct(), "candidates")
    full = _chunked(flagged.join(prepared.drop("dim"), "id"), [*cell, "label"], CELL_ROWS)
    order = [*cell, "label", "left", "right"]

    def verify(batches):
        for table_, edges in whole_groups(batches, order):
            made = [m for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1 and (m := meeting(table_.slice(a, b - a)))]
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()

    def meeting(group):
        dim, b, left, right = (group.column(c)[0].as_py() for c in ("dim", "block", "left", "right"))
        ids, visits, many, mine = (group.column(c).to_numpy() for c in ("id", "visits", "many", "own"))
        x, z = _components(group.column("x"), dim), _turned(group.column("x"), dim)
        norm, all_blocks = np.linalg.norm(x, axis=1), blocks(dim)
        columns = all_blocks[b]
        y, limit = z[:, columns], share(dim, columns)
        square = (y * y).sum(1)
        a_rows, b_rows = np.flatnonzero(mine == left), np.flatnonzero(mine == right)
        pairs = []
        for k in range(0, a_rows.size, 512):
            rows = a_rows[k : k + 512]
            close = square[rows, None] + square[None, b_rows] - 2 * (y[rows] @ y[b_rows].T) <= limit + 1e-7
            i, j = np.nonzero(close)
            i, j = rows[i], b_rows[j]
            keep = ~(visits[i] & visits[j]) & ((ids[i] < ids[j]) if left == right else (ids[i] != ids[j]))
            i, j = i[keep], j[keep]
            for start in range(0, i.size, 1 << 14):
                p, q = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
                gap = (z[p] - z[q]) ** 2
                ok = (gap[:, columns].sum(1) <= limit) & ((x[p] * x[q]).sum(1) / (norm[p] * norm[q]) >= cosine)
                for earlier in all_blocks[:b]:
                    ok &= gap[:, earlier].sum(1) > share(dim, earlier)
                pairs.append(np.stack([p[ok], q[ok]]))
        pairs = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
        n = np.zeros(ids.size, np.int64)
        np.add.at(n, pairs[0], many[pairs[1]])
        np.add.at(n, pairs[1], many[pairs[0]])
        root = ids.copy()
        while pairs.size:  # least id over the links of this task
            new = root.copy()
            np.minimum.at(new, pairs[0], root[pairs[1]])
            np.minimum.at(new, pairs[1], root[pairs[0]])
            if (new == root).all():
                break
            root = new
        rows = np.flatnonzero(n)
        return None if not rows.size else pa.table({"id": ids[rows], "n": n[rows], "root": root[rows]}, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "id long, n long, root long")


def _components(x, dim: int) -> np.ndarray:
    """Vectors in double precision, largest component 1 (which no cosine sees)."""
    raw = b"".join(x.to_pylist())
    a = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(x) else np.float64).reshape(len(x), dim).astype(np.float64)
    return a / np.abs(a).max(1, keepdims=True)


def _turned(x, dim: int) -> np.ndarray:
    a = _components(x, dim)
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ rotation(dim)


def _prepare(rows: DataFrame, width: int) -> DataFrame:
    """id, label, dim, x (components as bytes of ``width``), many."""

    def step(batch):
        x = batch.column("x")
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(f"f{width}")
        at = x.offsets.to_numpy() - x.offsets[0].as_py()
        bodies = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(np.diff(at).astype(np.int32)), pa.array(bodies, pa.binary()), batch.column("many")], ["id", "label", "dim", "x", "many"])

    return map_rows(rows.select("id", "label", "x", "many"), step, "id long, label string, dim int, x binary, many long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero or hold null or non-finite components, rows without label and
    rows without key link with nothing and are their own component. Rows that share a key are
    one vector (of least hash among the usable ones). Equal vectors of a label are one with a
    multiplicity and link with each other; ties cannot arise. Other columns are ignored, whatever
    their names. No rows give no rows.
    """
    narrow = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).alias(vector), F.col(label).alias(label))
    ready, same = usable(narrow, key, vector, label), ["f1", "f2"]
    chosen = ready.groupBy("id").agg(F.min(F.struct(*same)).alias("f")).select("id", "f.*")
    chosen = materialize(chosen, "prints")
    reps = materialize(chosen.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("many")), "distinct-vectors")
    first = ready.join(reps, ["id", *same]).groupBy("id").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.first("many").alias("many"))
    kind = narrow.schema[vector].dataType.elementType
    prepared = materialize(_prepare(first, 4 if isinstance(kind, S.FloatType) else 8), "vectors")
    links = materialize(link(prepared, cosine), "vector-links")
    discard(prepared)
    counted = links.groupBy("id").agg(F.sum("n").alias("n"))
    labelled = components(links, "id", "root").withColumnRenamed("node", "id")
    found = reps.join(counted, "id", "left").join(labelled, "id", "left")
    n: Column = F.coalesce("n", F.lit(0)) + F.col("many") - 1
    found = found.select(*same, n.alias("n_links"), F.coalesce("component", "id").alias("component"))
    each = chosen.join(found, same).select(F.col("id").alias("_id"), "n_links", "component")
    out = narrow.select(key).join(each, F.col(key) == F.col("_id"), "left")
    return out.select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col(key)).cast("long").alias("component_id"),
        F.coalesce(F.col("component") == F.col(key), F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, m) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(m, vec_id)::BIGINT AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON n = vec_id LEFT JOIN d ON a = vec_id"""
