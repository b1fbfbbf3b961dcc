"""MinHash near-duplicates with BagMinHash signatures of weighted shingles.

A shingle that occurs w times covers weights (0, w]. The weight axis is a hierarchy of discrete
intervals: (0, 2^k] splits into (0, 2^(k-1)] and (2^(k-1), 2^k], and the Poisson process of an
interval is the union of its halves' processes. So only the halves that a weight reaches carry
processes of their own; in the uppermost one, which the weight may cover in part, a point's place
is drawn at once (the same in distribution as splitting that half further, one bit a level) and
the point counts if its place is covered. Each register keeps its earliest point; two signatures
agree in a register with the weighted Jaccard probability. Points are drawn in order of time and
a process ends once it is later than every register, so a text of n shingles costs about
n + m log m points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, table, text_chunks
from .graph import components
from .rolling import mix
from .shingles import shingles

REGISTERS, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 shares none with probability 5e-8
#: Signature agreement below which a pair at 0.8 falls with probability 7.6e-8; it is not verified.
LEAST_AGREEMENT = 77
#: Members of one bucket that meet in a task; larger buckets meet in pairs of chunks.
BUCKET_ROWS = 4096
#: Bytes of the texts that meet in a task when members are verified in place.
BUCKET_BYTES = 4 << 20


def bag_minhash(text: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x registers, 16 bits each) of weighted elements."""
    level = np.ceil(np.log2(weight)).astype(np.int64)  # pieces (0,1], (1,2], (2,4], ...
    times = np.repeat(np.arange(weight.size), level + 1)
    piece = np.arange(times.size) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    text, weight, seed = text[times], weight[times].astype(float), mix(key[times] + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.where(piece == 0, 0.0, 2.0 ** (piece - 1))
    width = np.where(piece == 0, 1.0, low)
    earliest, clock, step = np.full(texts * registers, np.inf), np.zeros(text.size), 0
    while text.size:
        step += 1
        draw = mix(seed + np.uint64(step * 0xE7037ED1A0B428DB % 2**64))
        clock = clock - np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / width
        draw = mix(draw)
        register = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
        covered = low + width * ((draw >> np.uint64(32)).astype(float) + 0.5) * 2.0**-32 <= weight
        np.minimum.at(earliest, text[covered] * registers + register[covered], clock[covered])
        latest = earliest.reshape(texts, registers).max(1)
        on = clock < latest[text]
        text, weight, seed, low, width, clock = (a[on] for a in (text, weight, seed, low, width, clock))
    return (mix(earliest.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).reshape(texts, registers)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), n (shingles with repeats), a 128-bit fingerprint of the
    multiset, signature."""

    def step(batch):
        for start, stop in text_chunks(batch, "text", 1 << 20):
            part = batch.slice(start, stop - start)
            text, key, count = shingles(part.column("text").to_pylist(), words)
            rows = stop - start
            n = np.bincount(text, count, rows).astype(np.int64)
            prints = []
            for salt in (3, 5):
                value, total = mix(key + np.uint64(salt)) * count.astype(np.uint64), np.zeros(rows, np.uint64)
                np.add.at(total, text, value)
                prints.append(total.view(np.int64))
            sig = bag_minhash(text, key, count, rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("th"), pa.array(n), *map(pa.array, prints), pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())],
                ["doc_id", "th", "n", "f1", "f2", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return map_rows(rows, step, "doc_id long, th long, n long, f1 long, f2 long, sig binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Pairs (a, b) whose multisets of shingles overlap by ``similarity`` or more."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))

    def step(batch):
        keep = []
        a, b = batch.column("ta"), batch.column("tb")
        for k in range(0, batch.num_rows, 128):
            both = a.slice(k, 128).to_pylist() + b.slice(k, 128).to_pylist()
            rows = len(both) // 2
            text, key, count = shingles(both, words)
            total = np.bincount(text, count, 2 * rows)
            pair = text % rows
            order = np.lexsort((key, pair))
            pair, key, count = pair[order], key[order], count[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (key[1:] == key[:-1]))
            overlap = np.bincount(pair[same], np.minimum(count[same], count[same + 1]), rows)
            union = total[:rows] + total[rows:] - overlap
            keep.append((overlap >= similarity * union - 1e-9) & (union > 0))
        mask = pa.array(np.concatenate(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), step, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough to be worth reading the texts."""

    def step(batch):
        mask = pa.array(_agreement(_sigs(batch.column("sa")), _sigs(batch.column("sb"))) >= LEAST_AGREEMENT)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    a, b = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return map_rows(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), step, "a long, b long")


def _earlier_band(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether signatures also meet in a bucket of an earlier band."""
    return (a[..., : band * ROWS] == b[..., : band * ROWS]).reshape(len(b), band, ROWS).all(-1).any(-1)


def _meetings(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows of a bucket in chunks of about ``most`` (of what ``size`` sums up), which meet in pairs."""
    bucket = ["band", "hash"]
    crowded = rows.groupBy(*bucket).agg(F.ceil(F.sum(size) / most).cast("int").alias("chunks")).filter("chunks > 1")
    chunked = rows.join(crowded, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = chunked.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return dealt.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})


def _partners(i: int, left: int, right: int, band: int, own: np.ndarray, comp: np.ndarray, sig: np.ndarray, big: np.ndarray) -> np.ndarray:
    """Members that row i is to be compared with here: of other components, likely, and in no
    earlier bucket together; each pair is met from one side only."""
    j = np.flatnonzero((own == right) & (comp != comp[i]) & ((np.arange(own.size) > i) | big | (left != right)))
    j = j[_agreement(sig[i], sig[j]) >= LEAST_AGREEMENT]
    return j[~_earlier_band(sig[i], sig[j], band)] if band else j


def _sides(keys, group):
    """Columns of a meeting, the rows to go through, and members of its largest component."""
    band, left, right = keys[0].as_py(), keys[2].as_py(), keys[3].as_py()
    own, rep, comp, sig = group.column("own").to_numpy(), group.column("rep").to_numpy(), group.column("comp").to_numpy().copy(), _sigs(group.column("sig"))
    labels, sizes = np.unique(comp, return_counts=True)
    big = (comp == labels[sizes.argmax()]) & (left == right)
    return band, left, right, own, rep, comp, sig, big, np.flatnonzero((own == left) & ~big)


def _across(members: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links between different components inside the buckets of (band, hash, rep, comp, sig).

    The first pass finds members with a likely partner by signatures alone; only these meet
    again with their texts. There every likely pair is verified in the first bucket that it
    shares, and a spanning forest of the links leaves the task: templates that resemble each
    other just below the threshold cost comparisons in memory, but no rows.
    """
    bucket, at = ["band", "hash"], ["band", "hash", "left", "right"]
    mixed = members.groupBy(*bucket).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(*bucket)
    rows = members.join(mixed, bucket).select(*bucket, "rep", "comp", "sig")

    def flag(keys, group):
        band, left, right, own, rep, comp, sig, big, through = _sides(keys, group)
        hit = np.zeros(rep.size, bool)
        for i in through.tolist():
            j = _partners(i, left, right, band, own, comp, sig, big)
            hit[j] = True
            hit[i] |= bool(j.size)
        rep = rep[hit]
        return pa.table({"band": pa.array(np.full(rep.size, band, np.int32)), "hash": pa.array(np.full(rep.size, keys[1].as_py(), np.int64)), "rep": rep})

    flagged = _meetings(rows, F.lit(1), BUCKET_ROWS).groupBy(*at).applyInArrow(flag, "band int, hash long, rep long").distinct()
    flagged = materialize(flagged, "flagged")
    full = flagged.join(rows, [*bucket, "rep"]).join(texts, "rep")

    def connect(keys, group):
        band, left, right, own, rep, comp, sig, big, through = _sides(keys, group)
        text, key, count = shingles(group.column("text").to_pylist(), words)
        distinct, code = np.unique(key, return_inverse=True)
        total = np.bincount(text, count, rep.size)
        n = np.bincount(text, minlength=rep.size)
        first, held, found = np.cumsum(n) - n, np.zeros(distinct.size, np.int64), []
        for i in through.tolist():
            j = _partners(i, left, right, band, own, comp, sig, big)
            if not j.size:
                continue
            mine = slice(first[i], first[i] + n[i])
            held[code[mine]] = count[mine]
            ends = np.cumsum(n[j])
            where = np.arange(ends[-1]) + np.repeat(first[j] - (ends - n[j]), n[j])
            overlap = np.bincount(np.repeat(np.arange(j.size), n[j]), np.minimum(held[code[where]], count[where]), j.size)
            held[code[mine]] = 0
            for k in j[overlap >= similarity * (total[i] + total[j] - overlap) - 1e-9].tolist():
                if comp[k] != comp[i]:
                    found.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                    comp[comp == comp[k]] = comp[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = _meetings(full, F.octet_length("text").cast("long"), BUCKET_BYTES)
    return met.select(*at, "own", "rep", "comp", "sig", "text").groupBy(*at).applyInArrow(connect, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, class_id, component_id, kept of every row.

    class_id: the smallest doc_id with the same multiset of shingles; component_id: the smallest
    doc_id among the rows reachable by pairs of ``similarity`` or more; kept: doc_id =
    component_id. Every row is judged by its own text: rows that share a doc_id may lie in
    different groups, and repeated rows are kept or not together. Texts without words (null, empty)
    link with nothing; rows without doc_id are kept and unlinked. A text of fewer than ``words``
    words is one shingle. Whole texts count, however long: a text is one row's value and has to fit
    in a task. Columns besides doc_id and text are ignored, whatever their names. No rows give no
    rows.

    Copies collapse into one representative before anything is banded. In a bucket every member
    is first verified against the least one; then only members of different components are
    compared, inside the bucket's tasks, so a bucket of g near copies costs g rows, not all pairs.
    """
    sigs = materialize(signatures(docs, words), "signatures")
    same = ["n", "f1", "f2"]
    usable = sigs.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    grouped = usable.groupBy(*same).agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("sig").alias("sig"))
    # A representative is a multiset, not a doc_id: its key is a number of its own, fixed by the written table.
    reps = materialize(grouped.select(F.monotonically_increasing_id().alias("rep"), *same, "first.*", "sig"), "representatives")
    narrow = materialize(sigs.select("doc_id", *same), "prints")
    discard(sigs)
    bands = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))).alias("band"), "sig")
    bands = bands.select("rep", "band", F.xxhash64(F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("hash"))
    bucket = ["band", "hash"]
    shared = bands.groupBy(*bucket).agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).filter("leader <> most").drop("most")
    members = kept_members = materialize(bands.join(shared, bucket), "buckets")
    stars = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(_likely(stars, reps), "stars")
    wanted = reps.join(members.select("rep").distinct(), "rep").select("rep", F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    held = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(wanted, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t")))
    texts = materialize(held.groupBy("rep").agg(F.min("text").alias("text")), "texts")
    links = materialize(verify(stars, texts, similarity, words), "links")
    found = components(links)
    members = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).join(reps.select("rep", "sig"), "rep")
    more = materialize(_across(members.select(*bucket, "rep", "comp", "sig"), texts, similarity, words), "links")
    # The first components are links to their least node, so the second round starts from those.
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)).withColumnRenamed("node", "rep")
    placed = materialize(reps.select(*same, "rep", "doc_id").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    discard(reps, kept_members, stars, texts, links, more)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = placed.join(least, "component").select(*[F.col(c).alias(f"_{c}") for c in same], F.col("doc_id").alias("class_id"), "component_id")
    on = [F.col(c) == F.col(f"_{c}") for c in same] + [F.col("doc_id").isNotNull()]
    out = narrow.join(groups, on, "left")
    class_id, component = F.coalesce("class_id", "doc_id"), F.coalesce("component_id", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", class_id.alias("class_id"), component.alias("component_id"), kept.alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
