"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Every removal comes from the sorted order: tasks sort local runs of suffixes and front-code
them, ranges of them are exchanged, and loser trees merge them without comparing a known common
prefix again. The prefix that neighbours in the order share is the verdict.

Hashes only choose which suffixes are worth sorting. Every ``length``-byte string belongs to the
minimizer (the least hash of the k-byte strings inside it); neighbouring strings with one
minimizer form a segment, and equal strings always have equal minimizers, so a minimizer that
occurs once rules its segment out. Of the segments that look equal as a whole, the first and the
last place are sorted, neighbouring ones as one piece; the others follow once the first is
proved. Segments that share only a minimizer with others give the suffixes of those starts that
look repeated.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, table, text_chunks, whole_groups
from .rolling import Rolling, mix

#: Texts are scanned in pieces of this many bytes, so memory does not follow a text's length.
SCAN_BYTES = 4 << 20
#: Segments of one minimizer that meet in a task; those of commoner ones are matched by a shuffle of their strings' hashes.
BUCKET_ROWS = 1500
#: Segments of whole minimizers that are looked at together.
MEET_ROWS = 2000
#: Starts in one piece of segments in a row.
PIECE_STARTS = 4096
#: Suffixes, and bytes of them, in one sorted run.
RUN_ROWS, RUN_BYTES = 30_000, 12 << 20
#: Bytes of suffixes in one range of the merge.
RANGE_BYTES = 16 << 20
#: Ranges that are told apart at once; where more are needed, each of these is cut again.
COARSE = 2048
#: Sampled suffixes per range (2048 in all at least) that place the ranges; they balance the merge and never change results.
SAMPLE = 8
#: Tasks that cut the blocks of one coarse range.
SALTS = 16
KEY = ["doc", "th"]


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, minimizer hash, segment hash) of all texts in ``data``."""
    k = length // 2
    window, n = length - k + 1, data.size - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    rolling = Rolling(data)
    grams = rolling.every(k)
    low = np.uint64(0xFFFFFF)
    keyed = (grams & ~low) | np.arange(grams.size, dtype=np.uint64)
    rows = np.concatenate([keyed, np.full(-grams.size % window, 2**64 - 1, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), "right")
    inside = np.arange(n) + length <= np.append(ends, 0)[np.minimum(text, ends.size)]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    good = inside[first]
    first, last = first[good], last[good]
    return text[first], first - begins[text[first]], last - begins[text[first]], grams[at[first]], rolling.of(first, last + length)


def anchors(keyed: DataFrame, length: int) -> DataFrame:
    """Segments of every text: doc, th, at (first and last start, 32 bits each), h1, h2, again. One
    that repeats inside a text is given once, with its number n, its last place s2 and the ranges
    (s, e) of all its places in ``again``, which is null for the others: rows stay narrow."""

    def scan(column):
        for start, stop in text_chunks(pa.record_batch([column], ["text"]), "text", 1 << 20):
            raws = [(t or "").encode() for t in column.slice(start, stop - start).to_pylist()]
            if len(raws) > 1 or len(raws[0]) <= SCAN_BYTES:
                sizes = np.array([len(r) for r in raws], np.int64)
                ends = np.cumsum(sizes)
                text, *rest = segments(np.frombuffer(b"".join(raws), np.uint8), ends - sizes, ends, length)
                yield text + start, *rest
                continue
            for at in range(0, len(raws[0]), SCAN_BYTES):
                part = np.frombuffer(raws[0], np.uint8)[at : at + SCAN_BYTES + length - 1]
                text, s, e, *rest = segments(part, np.zeros(1, np.int64), np.array([part.size]), length)
                yield text + start, s + at, e + at, *rest

    def step(batch):
        for text, s, e, h1, h2 in scan(batch.column("text")):
            if not text.size:
                continue
            order = np.lexsort((s, h2, h1, text))
            text, s, e, h1, h2 = (a[order] for a in (text, s, e, h1, h2))
            new = np.ones(text.size, bool)
            new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], text.size)
            count = (ends - heads).astype(np.int32)
            gap = new.copy()
            gap[1:] |= s[1:] > e[:-1] + 1
            gap &= np.repeat(count > 1, count)
            begin = np.flatnonzero(gap)  # of ranges of places in a row
            edge = np.append(np.flatnonzero(gap | new), text.size)
            stop = edge[np.searchsorted(edge, begin, "right")] - 1
            ranges = pa.StructArray.from_arrays([pa.array(s[begin].astype(np.int32)), pa.array(e[stop].astype(np.int32))], ["s", "e"])
            offsets = np.append(np.searchsorted(begin, heads), begin.size).astype(np.int32)
            again = pa.StructArray.from_arrays([pa.array(count), pa.array(s[ends - 1].astype(np.int32)), pa.ListArray.from_arrays(offsets, ranges)], ["n", "s2", "places"], mask=pa.array(count == 1))
            pick = pa.array(text[heads])
            at = s[heads].astype(np.int64) << 32 | e[heads].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pick), batch.column("th").take(pick), pa.array(at), pa.array(h1[heads].view(np.int64)), pa.array(h2[heads].view(np.int64)), again], ["doc", "th", "at", "h1", "h2", "again"])

    return map_rows(keyed.select(*KEY, "text"), step, "doc long, th long, at long, h1 long, h2 long, again struct<n:int,s2:int,places:array<struct<s:int,e:int>>>")


def typed(found: DataFrame) -> DataFrame:
    """Segments whose minimizer repeats, with the total of equal ones, whether others share the
    minimizer, and the first and last place of the equal ones where this row is one of them.

    What is counted by a key is written before rows are joined with it: both sides of the join are
    then plain shuffles, and the rows of a common key can be split over tasks (a join whose other
    side ends in an aggregate is never split)."""
    n = F.coalesce("again.n", F.lit(1))
    repeated = found.groupBy("h1").agg(F.sum(n).alias("total"), F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("total > 1")
    repeated = materialize(repeated.select("h1", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated")
    joined = found.join(repeated, "h1")
    s = F.shiftright("at", 32).cast("int")
    places = [s.alias("s"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("e"), n.alias("n"), F.coalesce("again.s2", s).alias("s2"), F.col("again.places").alias("places")]
    hits = materialize(joined.select(*KEY, "h1", "h2", "mixed", *places), "hits")
    here, there = F.struct(*KEY, "s"), F.struct(*KEY, F.col("s2").alias("s"))
    groups = hits.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min(here).alias("first"), F.max(there).alias("last"))
    groups = materialize(groups.filter("total > 1"), "groups")
    rows = hits.join(groups, ["h1", "h2"], "left").withColumn("total", F.coalesce("total", F.lit(1).cast("long")))  # without a group: alone
    first, last = F.when(F.col("last") == there, F.col("first")), F.when(F.col("first") == here, F.col("last"))
    out = materialize(rows.select(*KEY, "s", "e", "s2", "places", "h1", "h2", "mixed", "total", first.alias("first"), last.alias("last")), "typed")
    discard(repeated, hits, groups)
    return out


FIRST, LAST, PART = 0, 1, 2


def bodies(keyed: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Bytes to look at: (doc, th, s, judged, body, h1, groups).

    With h1 null the body is a piece: equal segments in a row, at their first place (judged, with
    the groups (h1, h2, e) that it stands for) or at their last. Both are cut alike, since what
    ends a piece (a gap, another partner, its size) shows on both sides. With h1 a body is a segment
    that shares its minimizer with others: judged if no other equals it, else the first place.
    """
    null, away = F.lit(None), F.col("e") - F.col("s")
    mark = lambda kind, s, other: F.struct(
        s.alias("s"), (s + away).cast("int").alias("e"), F.lit(kind).alias("kind"), "h1", "h2", "mixed",
        other["doc"].alias("doc"), other["th"].alias("th"), other["s"].alias("at"),
    )
    nothing = F.struct(null.cast("long").alias("doc"), null.cast("long").alias("th"), null.cast("int").alias("s"))
    one = F.when(F.col("total") == 1, mark(PART, F.col("s"), nothing))
    first, last = F.when(F.col("last").isNotNull(), mark(FIRST, F.col("s"), F.col("last"))), F.when(F.col("first").isNotNull(), mark(LAST, F.col("s2"), F.col("first")))
    marks = rows.filter("total = 1 or first is not null or last is not null").select(F.col("doc").alias("_d"), F.col("th").alias("_t"), F.explode(F.array_compact(F.array(one, first, last))).alias("m"))
    per_text = marks.groupBy("_d", "_t").agg(F.collect_set("m").alias("marks"))
    texts = keyed.select(*KEY, "text").join(per_text, (F.col("doc") == F.col("_d")) & (F.col("th") == F.col("_t")))
    group = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("e", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), group)

    def pieces(raw, marks):
        chains = sorted((m["kind"], m["doc"], m["th"], m["at"] - m["s"], m["s"], m["e"], m["h1"], m["h2"]) for m in marks)
        held = []
        for m in [*chains, None]:
            if held and (m is None or m[:4] != held[-1][:4] or m[4] != held[-1][5] + 1 or m[5] - held[0][4] >= PIECE_STARTS):
                judged, s = held[0][0] == FIRST, held[0][4]
                yield s, judged, raw[s : held[-1][5] + length], None, [{"h1": x[6], "h2": x[7], "e": x[5]} for x in held] if judged else []
                held = []
            held.append(m)

    def step(batch):
        for k in range(0, batch.num_rows, 200):
            part, out = batch.slice(k, 200), []
            for doc, th, text, marks in zip(*(part.column(c).to_pylist() for c in (*KEY, "text", "marks")), strict=True):
                raw = text.encode()
                out += [(doc, th, *x) for x in pieces(raw, [m for m in marks if m["kind"] != PART])]
                out += [(doc, th, m["s"], m["kind"] == PART, raw[m["s"] : m["e"] + length], m["h1"], []) for m in marks if m["kind"] == PART or (m["kind"] == FIRST and m["mixed"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [*KEY, "s", "judged", "body", "h1", "groups"])

    schema = "doc long, th long, s int, judged boolean, body binary, h1 long, groups array<struct<h1:long,h2:long,e:int>>"
    return map_rows(texts.select(*KEY, "text", "marks"), step, schema)


_SUFFIX = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("judged", pa.bool_()), ("body", pa.binary())])


def _cut_runs(place: np.ndarray, partners: np.ndarray) -> list[tuple[int, int]]:
    """First and last of neighbouring places that occur in the same segments."""
    new = np.ones(place.size, bool)
    new[1:] = (np.diff(place) != 1) | (partners[1:] != partners[:-1])
    first = np.flatnonzero(new)
    return list(zip(place[first].tolist(), place[np.append(first[1:], place.size) - 1].tolist(), strict=True))


def runs(parts: DataFrame, length: int) -> DataFrame:
    """Suffixes worth sorting: (doc, th, p, judged, body) where the strings at p, p+1, ... look as if
    they occur in the same segments, so that all of these have a suffix that starts at the same place."""
    crowded = parts.groupBy("h1").agg(F.count("*").alias("size")).filter(F.col("size") > BUCKET_ROWS).select("h1")

    def meet(batches):
        for group, _ in whole_groups(batches, ["h1"], MEET_ROWS):  # equal strings have equal minimizers, so all may meet at once
            body = group.column("body").to_pylist()
            size = np.array([len(b) for b in body])
            begin, many = np.cumsum(size) - size, size - length + 1
            row = np.repeat(np.arange(size.size), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            prints = Rolling(np.frombuffer(b"".join(body), np.uint8)).every(length)[begin[row] + place]
            _, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
            partners = np.zeros(count.size, np.uint64)
            np.add.at(partners, inverse, mix(row.astype(np.uint64) + np.uint64(1)))
            alive = np.flatnonzero(count[inverse] > 1)
            row, place, partners = row[alive], place[alive], partners[inverse[alive]]
            new = np.ones(row.size, bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (partners[1:] != partners[:-1])
            first = np.flatnonzero(new)
            if not first.size:
                continue
            r, x, y = row[first], place[first], place[np.append(first[1:], row.size) - 1]
            out = [body[i][a : b + length] for i, a, b in zip(r.tolist(), x.tolist(), y.tolist(), strict=True)]
            pick, p = pa.array(r), pa.array(group.column("s").to_numpy()[r] + x, pa.int32())
            picked = pa.table([group.column("doc").take(pick), group.column("th").take(pick), p, group.column("judged").take(pick), pa.array(out, pa.binary())], schema=_SUFFIX)
            yield from picked.to_batches()

    def strings(batch):
        for k in range(0, batch.num_rows, 500):
            rows = batch.slice(k, 500)
            bodies_ = rows.column("body").to_pylist()
            prints = [Rolling(np.frombuffer(b, np.uint8)).every(length) for b in bodies_]
            pick = pa.array(np.repeat(np.arange(len(prints)), [x.size for x in prints]))
            place = np.concatenate([np.arange(x.size, dtype=np.int32) for x in prints])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pick) for c in (*KEY, "s")), pa.array(place), pa.array(np.concatenate(prints).view(np.int64))], [*KEY, "s", "place", "print"])

    def common(batch):
        for k in range(0, batch.num_rows, 500):
            rows, out = batch.slice(k, 500), []
            for doc, th, s, judged, body, found in zip(*(rows.column(c).to_pylist() for c in (*KEY, "s", "judged", "body", "found")), strict=True):
                found = sorted((f["place"], f["partners"]) for f in found)
                place, partners = (np.array(x) for x in zip(*found, strict=True))
                out += [(doc, th, s + x, judged, body[x : y + length]) for x, y in _cut_runs(place, partners)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUFFIX, strict=True)], schema=_SUFFIX)

    schema = "doc long, th long, p int, judged boolean, body binary"
    few = parts.join(crowded, "h1", "left_anti").select("h1", *KEY, "s", "judged", "body")
    few = few.repartition("h1").sortWithinPartitions("h1").mapInArrow(meet, schema)
    many = parts.join(crowded, "h1", "left_semi").select(*KEY, "s", "judged", "body")
    each = map_rows(many, strings, "doc long, th long, s int, place int, print long")
    who = F.xxhash64(*KEY, "s")
    halves = [F.sum(x) for x in (who.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(who, 32))]
    repeated = each.groupBy("print").agg(F.count("*").alias("n"), F.xxhash64(*halves).alias("partners")).filter("n > 1")
    found = each.join(repeated, "print").groupBy(*KEY, "s").agg(F.collect_set(F.struct("place", "partners")).alias("found"))
    return few.union(map_rows(many.join(found, [*KEY, "s"]), common, schema))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; ``known`` bytes of it need no look."""
    end, step = min(len(a), len(b)), 32
    while known < end:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            n = min(len(x), len(y))
            gap = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
            return known + (n - (gap.bit_length() + 7) // 8 if gap else n)
        known += step
        step *= 2
    return end


class LoserTree:
    """Merges sorted runs of (string, common prefix with the one before in its run, ...).

    Each inner node holds the loser of its match and the prefix it shares with the winner that
    passed. All strings are compared with the last one given out, so the one that shares more
    with it is the lesser, and only equal prefixes need a look at the bytes behind them.
    """

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        size = 1
        while size < len(self.sources):
            size *= 2
        self.size, self.item = size, [next(s, None) for s in self.sources] + [None] * (size - len(self.sources))
        self.shared = [0] * size  # of each run's first string with the last one given out
        self.loser = [0] * size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The winner of runs a and b; the loser stays at the node."""
        x, y = self.item[a], self.item[b]
        if x is None or y is None:
            win, lose = (b, a) if x is None else (a, b)
        elif self.shared[a] != self.shared[b]:
            win, lose = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            n = common_prefix(x[0], y[0], self.shared[a])
            win, lose = (a, b) if x[0][n : n + 1] <= y[0][n : n + 1] else (b, a)
            self.shared[lose] = n
        self.loser[node] = lose
        return win

    def __iter__(self):
        """(item, common prefix with the item before)."""
        while (item := self.item[self.winner]) is not None:
            w = self.winner
            yield item, self.shared[w]
            self.item[w] = after = next(self.sources[w], None)
            self.shared[w] = after[1] if after else 0
            node = (w + self.size) // 2
            while node:
                w = self._match(node, w, self.loser[node])
                node //= 2
            self.winner = w


def front_code(strings: list[bytes]) -> tuple[bytes, list[int]]:
    """A sorted run as (prefix shared with the one before, rest): headers, then rests."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(strings[:-1], strings[1:], strict=True)]
    rest = [len(s) - n for s, n in zip(strings, shared, strict=True)]
    head = np.array([shared, rest], "<u4").T.tobytes()
    return head + b"".join(s[n:] for s, n in zip(strings, shared, strict=True)), shared


def decoded(block: bytes, n: int, index: int):
    """(string, shared, run, place) of a front-coded run."""
    head, at, before = np.frombuffer(block, "<u4", 2 * n).reshape(n, 2).tolist(), 8 * n, b""
    for place, (shared, rest) in enumerate(head):
        before = before[:shared] + block[at : at + rest]
        at += rest
        yield before, shared, index, place


def sampled(suffixes: DataFrame, most: int, rows: int) -> DataFrame:
    """About ``most`` of the suffixes (all of them, if there are no more), the same ones every time."""
    draw = F.pmod(F.xxhash64("body", *KEY, "p"), F.lit(1 << 30))
    return suffixes.filter(draw < F.lit(int(min(1.0, most / max(rows, 1)) * (1 << 30))))


def quantiles(ordered: list[bytes], ranges: int) -> list[bytes]:
    """Strings that part a sorted sample into ``ranges``; they are as long as what makes a repeat, so
    common starts are parted by what follows. Fewer where one string fills several ranges."""
    return sorted({ordered[len(ordered) * k // ranges] for k in range(1, ranges)}) if ordered else []


def cut_at(ordered: list[bytes], splits: list[bytes]) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that a sorted run has strings in; only the splits between its
    first and last string are looked at."""
    if not ordered:
        return []
    first, last = bisect_right(splits, ordered[0]), bisect_right(splits, ordered[-1])
    cuts = [0, *(bisect_left(ordered, x) for x in splits[first:last]), len(ordered)]
    return [(first + k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def refined(suffixes: DataFrame, coded: DataFrame, splits: list[bytes], finer: int, rows: int, length: int) -> DataFrame:
    """The runs of ``coded`` cut again, each coarse range into about ``finer``.

    The finer splits of a range are quantiles of its own part of a distributed sample, and reach
    the tasks that cut its blocks as a row in front of these; no task and no closure holds those
    of all ranges.
    """

    def coarse(batch):
        body = batch.column("body").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([bisect_right(splits, b) for b in body], pa.int64()), pa.array(body, pa.binary())], ["range", "body"])

    drawn = map_rows(sampled(suffixes, SAMPLE * finer * (len(splits) + 1), rows).select("body"), coarse, "range long, body binary")
    inner = drawn.groupBy("range").agg(F.sort_array(F.collect_list("body")).alias("drawn"))
    at = F.transform(F.sequence(F.lit(1), F.lit(finer - 1)), lambda k: F.floor(F.size("drawn") * k / finer).cast("int"))
    inner = inner.select("range", F.array_distinct(F.transform(at, lambda k: F.get("drawn", k))).alias("splits"))
    blocks = coded.filter("range >= 0").select("*", F.pmod(F.xxhash64("run"), F.lit(SALTS)).alias("salt"), F.lit(None).cast("array<binary>").alias("splits"))
    head = inner.select("range", "splits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    both = blocks.unionByName(head, allowMissingColumns=True).withColumn("block_row", F.col("run").isNotNull())
    n = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(splits) + 1)
    dealt = both.repartition(n, "range", "salt").sortWithinPartitions("range", "salt", "block_row")
    names = ["range", "run", "block", *KEY, "p", "last"]
    kinds = [pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 4]

    def cut(batches):
        of, inside = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in (*names, "splits")}
                if r["range"] != of:
                    of, inside = r["range"], []
                if r["run"] is None:
                    inside = [bytes(x) for x in r["splits"]]
                    continue
                strings = [x[0] for x in decoded(r["block"], len(r["p"]), 0)]
                for k, a, b in cut_at([x[:length] for x in strings], inside):
                    out = (r["range"] * finer + k, r["run"], front_code(strings[a:b])[0], *(r[c][a:b] for c in (*KEY, "p", "last")))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names)

    lists = "doc array<long>, th array<long>, p array<long>, last array<long>"
    again = dealt.select(*names, "splits").mapInArrow(cut, f"range long, run string, block binary, {lists}")
    return again.union(coded.filter("range < 0").select(*names))


def sorted_verdicts(suffixes: DataFrame, length: int) -> DataFrame:
    """(doc, th, p, last): starts p..last repeat, by the sorted order of the suffixes.

    In a local run equal suffixes decide each other and one of them goes on, so a string that
    very many texts share costs one suffix a run. The number of ranges follows the bytes; what the
    driver and the tasks hold of their limits does not, since beyond ``COARSE`` ranges each is cut
    again by splits of its own. Suffixes that share ``length`` bytes meet in one range.
    """
    size = suffixes.agg(F.sum(F.octet_length("body").cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    wanted = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // RANGE_BYTES)
    ranges, finer = min(wanted, COARSE), -(-wanted // COARSE)
    start = F.substring("body", 1, length)  # what shares this much meets in one range
    drawn = [bytes(r[0]) for r in sampled(suffixes, max(2048, SAMPLE * ranges), size.rows).select(start).collect()]  # bounded by COARSE
    splits = quantiles(sorted(drawn), ranges)
    names = ["range", "run", "block", *KEY, "p", "last"]
    kinds = [pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 4]

    def local(batches):
        import uuid

        held, size = [], 0

        def run():
            held.sort(key=lambda r: r[0])
            done, kept = [], []  # decided here; one of each string goes on
            for r in held:
                if kept and kept[-1][0] == r[0]:
                    for x in (kept[-1], r):
                        if x[4]:
                            done.append((x[1], x[2], x[3], x[3] + len(x[0]) - length))
                    if r[4] and not kept[-1][4]:
                        kept[-1] = r
                else:
                    kept.append(r)
            held.clear()
            name, out = uuid.uuid4().hex, []
            for k, a, b in cut_at([r[0][:length] for r in kept], splits):
                block, _ = front_code([r[0] for r in kept[a:b]])
                out.append((k, name, block, *([r[i] for r in kept[a:b]] for i in (1, 2, 3)), [int(r[4]) for r in kept[a:b]]))
            done = list(dict.fromkeys(done))
            for k in range(0, len(done), 5000):
                out.append((-1, name, None, *map(list, zip(*done[k : k + 5000], strict=True))))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = list(zip(*(batch.slice(k, 1000).column(c).to_pylist() for c in ("body", *KEY, "p", "judged")), strict=True))
                held += rows
                size += sum(len(r[0]) for r in rows)
                if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                    yield from run()
                    size = 0
        if held:
            yield from run()

    lists = "doc array<long>, th array<long>, p array<long>, last array<long>"
    coded = materialize(suffixes.select("body", *KEY, "p", "judged").mapInArrow(local, f"range long, run string, block binary, {lists}"), "suffix-runs")
    if finer > 1:
        whole, coded = coded, materialize(refined(suffixes.withColumn("body", start), coded, splits, finer, size.rows, length), "suffix-runs")
        discard(whole)

    def merge(group):
        block, ids = group.column("block").to_pylist(), [group.column(c).to_pylist() for c in (*KEY, "p", "last")]
        tree = LoserTree(decoded(b, len(p), k) for k, (b, p) in enumerate(zip(block, ids[2], strict=True)))
        out, before, before_shared = [], None, 0

        def decide(item, best):
            _, _, k, place = item
            if best >= length and ids[3][k][place]:
                p = ids[2][k][place]
                out.append((ids[0][k][place], ids[1][k][place], p, p + best - length))

        for item, shared in tree:
            if before is not None:
                decide(before, max(before_shared, shared))
            before, before_shared = item, shared
        if before is not None:
            decide(before, before_shared)
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[*KEY, "p", "last"])

    merged = coded.filter("range >= 0").groupBy("range").applyInArrow(merge, "doc long, th long, p long, last long")
    local_ones = coded.filter("range < 0").select(F.explode(F.arrays_zip(*KEY, "p", "last")).alias("r")).select("r.*")
    out = materialize(merged.union(local_ones), "verdicts")
    discard(coded)
    return out


def spans_of(pairs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges of strings that start anywhere in the given ranges."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(pairs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; on request its text, its
    kept_text and the columns to carry.

    A byte goes if a ``length``-byte string over it also starts anywhere else, the same text
    included; overlaps count, matches never cross texts, all is judged on the input. A null text
    is an empty one. Rows that share doc_id and text are two places of their strings. Kept text
    that a cut leaves undecodable at its edges loses those bytes. Other columns are ignored; no
    rows give no rows. ``length`` is even and at least 32. A text is one value of a row and so
    fits in a task; what is scanned, sorted and merged of it is bounded by the sizes above.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    keyed = source.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "th": F.xxhash64("doc_id", "text")})
    found = materialize(anchors(keyed.filter(F.octet_length("text") >= length), length), "segments")
    rows = typed(found)
    discard(found)
    look = materialize(bodies(keyed, rows, length), "bodies")
    pieces = look.filter("h1 is null").select(*KEY, F.col("s").alias("p"), "judged", "body")
    suffixes = materialize(pieces.union(runs(look.filter("h1 is not null"), length)), "suffixes")
    verdicts = sorted_verdicts(suffixes, length)
    discard(suffixes)
    stands = look.filter("h1 is null and judged").select(*KEY, F.col("s").alias("p"), F.explode("groups").alias("g"))
    proved = stands.join(verdicts, [*KEY, "p"]).filter("last >= g.e").select("g.h1", "g.h2").distinct()
    proved = materialize(proved, "proved")
    places = F.coalesce("places", F.array(F.struct("s", "e")))
    followed = rows.filter("total > 1").select(*KEY, "h1", "h2", places.alias("spans")).join(proved, ["h1", "h2"]).select(*KEY, "spans")
    direct = verdicts.select(*KEY, F.array(F.struct(F.col("p").cast("int").alias("s"), F.col("last").cast("int").alias("e"))).alias("spans"))
    per_text = direct.union(followed).groupBy(F.col("doc").alias("_d"), F.col("th").alias("_t")).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    per_text = materialize(per_text, "spans")
    discard(rows, look, verdicts, proved)
    whole = keyed.withColumns({"n_bytes": F.octet_length("text").cast("long"), "whole": F.sha2("text", 256)})
    ready = whole.join(per_text, (F.col("doc") == F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    texts = ["text"] * with_text

    def cut(batch):
        columns = [batch.column(c) for c in ("doc_id", "n_bytes", *texts, *carry)]
        hit = np.flatnonzero(batch.column("spans").is_valid().to_numpy(zero_copy_only=False))
        removed, n_spans = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sha, left = batch.column("whole").to_pylist(), [None] * batch.num_rows
        for k in hit.tolist():
            raw, at, kept = batch.column("text")[k].as_py().encode(), 0, []
            spans = spans_of([(v["s"], v["e"]) for v in batch.column("spans")[k].as_py()], length)
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            removed[k], n_spans[k], sha[k] = len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()
            left[k] = kept.decode(errors="ignore") if with_text else None
        made = [pa.array(removed), pa.array(n_spans), pa.array(sha, pa.string())] + [pa.array(left, pa.string())] * with_text
        yield pa.RecordBatch.from_arrays([*columns, *made], ["doc_id", "n_bytes", *texts, *carry, "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text)

    types = dict(source.dtypes)
    extra = "".join(f", `{c}` {types[c]}" for c in (*texts, *carry))
    schema = f"doc_id {types['doc_id']}, n_bytes long{extra}, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    done = map_rows(ready.select("doc_id", "n_bytes", "text", *carry, "whole", "spans"), cut, schema)
    kept = [F.coalesce("kept_text", "text").alias("kept_text")] * with_text
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *texts, *kept, *carry)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=True).drop("text")
