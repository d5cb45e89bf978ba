"""Substring dedup by recompression: consistent names for runs and pairs of tokens, level by level.

A document starts as the sequence of its words' 64-bit names. Each round renames it: a maximal run of one short symbol becomes
a symbol (if the run is short enough to be placed at all), then every pair ab of short symbols with a in the round's left and
b in its right half of the alphabet becomes a symbol. Names are hashes of what they stand for, so all tasks agree on them
without an exchange, and equal stretches of any two documents get equal symbols except near their ends. How far a symbol's
existence depends on its surroundings is tracked exactly (``low``, ``high``): a window that holds all of that knows the symbol.

Round one is global over high-level symbols. Each window is represented by one symbol it knows, the longest; equal windows
choose the same, so a window whose symbol occurs nowhere else as such cannot be repeated. Windows that know no symbol stand
for themselves. Round two is global over the few windows left and compares 96-bit names of their
whole word sequences. Both go through ``repeated``: occurrences are shuffled as packed arrays by hash bucket, and a task sorts the
occurrences of its bucket; a hot passage fills one bucket, so the number of buckets has to follow the shuffle partitions of the job.

Documents with the same words (at least a window of them) are settled by a hash of the whole sequence: every window of theirs
is repeated. One of them still takes part, with all its windows counted twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, text_of

#: Longest symbol that still takes part in a round, by round.
CAPS = (1, 2, 4)
#: Longest run that becomes one symbol, in words, and the rounds that look for runs.
RUN = 8
RUN_ROUNDS = 2
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def name_words(text: str) -> tuple[list[bytes], np.ndarray]:
    import xxhash

    w = text.encode().split()
    return w, np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))


def parse(names: np.ndarray, lengths: np.ndarray, caps=CAPS) -> dict[str, np.ndarray]:
    """Symbols of a batch of documents: names of all their words one after the other, and each document's word count.

    Returns the top level's symbols: name, start, size, and ``low`` and ``high``, the stretch [low, high) that determines it.
    Positions count words over the whole batch. Document ends know nothing of what a window could see there.
    """
    n, far = len(names), np.int64(1) << 40
    start = np.arange(n, dtype=np.int64)
    size = np.ones(n, np.int64)
    bounds = np.cumsum(lengths)
    edge = np.zeros(n + 1, bool)  # boundaries between documents
    edge[0] = edge[bounds] = True
    at = np.arange(n + 1, dtype=np.int64)
    low, high = at.copy(), at.copy()  # of boundaries; a word's ends are known to all who see it
    mid = slice(1, -1)
    for r, cap in enumerate(caps):
        for runs in (True, False)[r >= RUN_ROUNDS :]:
            if len(names) < 2:
                break
            # What a symbol is rests on both its ends. Whether a boundary stays rests on the symbols on both sides, always, so
            # that two equal windows know the same symbols whatever lies outside them.
            sym_low, sym_high = np.minimum(low[:-1], low[1:]), np.maximum(high[:-1], high[1:])
            low, high = low.copy(), high.copy()
            low[mid], high[mid] = np.minimum(sym_low[:-1], sym_low[1:]), np.maximum(sym_high[:-1], sym_high[1:])
            low[edge], high[edge] = -far, n + far  # elsewhere the same words may go on
            short, inner = size <= cap, ~edge[mid]
            if runs:
                same = inner & (names[1:] == names[:-1]) & short[1:]
                first = np.concatenate([[0], np.flatnonzero(~same) + 1])
                count = np.diff(np.append(first, len(names)))
                fits = (count > 1) & (count * size[first] <= RUN)
                gone = same.copy()
                for k in np.flatnonzero((count > 1) & ~fits).tolist():
                    # Too long to become one symbol, which rests on all of it and its surroundings.
                    f, l = first[k], first[k] + count[k] - 1
                    gone[f:l] = False
                    low[f + 1 : l + 1] = min(low[f], low[f + 1])
                    high[f + 1 : l + 1] = max(high[l + 1], high[l])
                keep = np.concatenate([[True], ~gone])
                k = first[fits]
                names = names.copy()
                names[k] = mix(names[k] ^ mix(count[fits].astype(U) + U(977 * (r + 1))))
            else:
                side = (names >> U(7 + r)) & U(1)
                gone = inner & (short & (side == 0))[:-1] & (short & (side == 1))[1:]
                keep = np.concatenate([[True], ~gone])
                k = np.flatnonzero(gone)
                joined = mix(names[k] + (names[k + 1] ^ U(0x5EED + r)) * U(0x9E3779B97F4A7C15))
                names = names.copy()
                names[k] = joined
            names = names[keep]
            low, high, edge = (np.concatenate([x[:-1][keep], x[-1:]]) for x in (low, high, edge))
            total = np.append(start[keep], n)
            start, size = total[:-1], np.diff(total)
    if not len(names):
        return {"name": names, "start": start, "size": size, "low": start, "high": start}
    return {"name": names, "start": start, "size": size, "low": np.minimum(low[:-1], low[1:]), "high": np.maximum(high[:-1], high[1:])}


def window_names(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each stretch of ``width`` words, from all its words."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.uint32)
    a, b = np.zeros(n, U), np.zeros(n, U)
    other = mix(names)
    for k in range(width):
        a = a * U(0xD6E8FEB86659FD93) + names[k : k + n]
        b = b * U(0xC2B2AE3D27D4EB4F) + other[k : k + n]
    return mix(a), (mix(b) >> U(32)).astype(np.uint32)


def starts_of(lengths: np.ndarray, width: int) -> np.ndarray:
    """Word positions in a batch at which a window of one document starts."""
    ends = np.cumsum(lengths)
    ok = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    for e, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        ok[max(e - width + 1, e - n) : e] = False
    return np.flatnonzero(ok)


def anchors(symbols: dict, n: int, width: int) -> np.ndarray:
    """For each word position, which of the symbols known to the window starting there stands for it; -1 if it knows none.

    The longest symbol is taken, then the one of least hash, then the first: equal windows choose the same one.
    """
    low, high = symbols["low"], symbols["high"]
    known = np.flatnonzero((high - low <= width) & (low >= 0) & (high <= n))
    rank = (np.minimum(symbols["size"][known], 15).astype(U) << U(60)) | (~mix(symbols["name"][known]) >> U(4))
    known = known[::-1][np.argsort(rank[::-1], kind="stable")]  # the best last, as later values replace earlier ones
    first, last = np.maximum(high[known] - width, 0), low[known]
    count = last - first + 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    best = np.full(n, -1, np.int64)
    best[at] = np.repeat(known, count)
    return best


def _pack(buckets: int, key: np.ndarray, more: np.ndarray | None, owner: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    bucket = (key % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        o = order[cuts[b] : cuts[b + 1]]
        who, count = _lengths(owner[o])
        yield b, key[o].tobytes(), b"" if more is None else more[o].tobytes(), who.tobytes(), count.tobytes(), pos[o].astype(np.int32).tobytes()


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.append(new, len(x))).astype(np.int32)


PACKED = "bucket int, keys binary, more binary, owners binary, counts binary, places binary"


def repeated(packed: DataFrame) -> DataFrame:
    """(owner, places) of the occurrences whose name occurs at least twice, some rows for each owner."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        key, more, pos = get("keys", U), get("more", np.uint32), get("places", np.int32)
        owner = np.repeat(get("owners", np.int64), get("counts", np.int32))
        order = np.lexsort((more, key)) if len(more) else np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        if len(more):
            same &= more[order][1:] == more[order][:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        o = np.sort(order[twice])
        o = o[np.argsort(owner[o], kind="stable")]
        who, count = _lengths(owner[o])
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(pos[o]))
        return pa.Table.from_arrays([pa.array(who), lists], ["owner", "places"])

    return packed.groupBy("bucket").applyInArrow(run, "owner long, places array<int>")


def by_owner(rows: DataFrame) -> DataFrame:
    return rows.groupBy("owner").agg(F.flatten(F.collect_list("places")).alias("places"))


def _batches(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    other = [c.to_pylist() for k, c in enumerate(batch.columns) if k != 1]
    for k, t in enumerate(batch.column(1)):
        yield (other[0][k], t.as_py(), *(c[k] for c in other[1:]))


def _named(part: list[tuple]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words, names = zip(*(name_words(r[1]) for r in part), strict=True)
    return list(words), np.concatenate(names), np.array([len(w) for w in words], np.int64)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 5
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])


def dedup_substrings(docs: DataFrame, width: int = 35, block_chars: int = 1 << 21) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts anywhere else in ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_removed, kept_sha256 and ``removed`` (array of removed word stretches, start and end). Windows
    are judged on the input. Null and empty texts have no words. Equal rows are occurrences of their own; a null doc_id stays;
    other columns are ignored; no rows give no rows. ``block_chars``: text handled at once in a task, or one document.
    """
    buckets = 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select("doc_id", text_of().alias("text")).withColumn("owner", F.xxhash64("doc_id", "text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(_rows(batch), block_chars):
                _, names, lengths = _named(part)
                n = len(names)
                owners = np.array([r[0] for r in part], np.int64)
                doc_of = np.repeat(np.arange(len(part)), lengths)
                base = np.concatenate([[0], np.cumsum(lengths)])
                s = parse(names, lengths)
                starts = starts_of(lengths, width)
                best = anchors(s, n, width)[starts]
                alone = starts[best < 0]  # windows that know no symbol stand for themselves
                used = np.unique(best[best >= 0])
                key = np.concatenate([s["name"][used], mix(window_names(names, width)[0][alone] ^ U(1)) if len(alone) else np.zeros(0, U)])
                at = np.concatenate([s["start"][used], alone])
                doc = doc_of[at]
                pos = at - base[doc]
                pos[len(used) :] = -1 - pos[len(used) :]
                yield _record(list(_pack(buckets, key, None, owners[doc], pos)))

    marks = materialize(by_owner(repeated(own.select("owner", "text").mapInArrow(first, PACKED))), "substr-marks")
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    summary = own.select("doc_id", "owner", split.alias("w")).select("doc_id", "owner", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("all_sha256"))
    summary = materialize(summary, "substr-docs")
    copies = materialize(
        summary.where(F.col("n_words") >= width).groupBy("all_sha256").agg(F.count("*").alias("copies"), F.min("owner").alias("chosen")).where("copies > 1"), "substr-copies"
    )
    summary = summary.join(copies, "all_sha256", "left")
    todo = summary.where("(copies is null or owner = chosen)").join(marks, "owner").select("owner", F.coalesce("copies", F.lit(1)).alias("copies"), "places").dropDuplicates(["owner"])
    todo = materialize(todo, "substr-todo")
    work = own.select("owner", "text").join(todo, "owner").select("owner", "text", "copies", "places")
    work = materialize(work, "substr-work")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(_rows(batch), block_chars // 4):
                _, names, lengths = _named(part)
                n, base = len(names), np.concatenate([[0], np.cumsum(lengths)])
                places = [np.array(r[3], np.int64) for r in part]
                s = parse(names, lengths)
                shared = np.zeros(n + 1, bool)
                standing = np.zeros(n, bool)
                for k, p in enumerate(places):
                    shared[base[k] + p[p >= 0]] = True
                    standing[base[k] - 1 - p[p < 0]] = True
                starts = starts_of(lengths, width)
                best = anchors(s, n, width)[starts]
                starts = starts[np.where(best < 0, standing[starts], shared[s["start"][best]])]
                if not len(starts):
                    continue
                a, b = window_names(names, width)
                doc = np.repeat(np.arange(len(part)), lengths)[starts]
                twice = np.array([r[2] > 1 for r in part])[doc]
                take = np.concatenate([starts, starts[twice]])
                doc = np.concatenate([doc, doc[twice]])
                owners = np.array([r[0] for r in part], np.int64)[doc]
                yield _record(list(_pack(buckets, a[take], b[take], owners, take - base[doc])))

    found = by_owner(repeated(work.mapInArrow(second, PACKED))).withColumnRenamed("places", "windows")
    result = work.where("copies = 1").select("owner", "text").join(found, "owner")
    stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for owner, text, windows in _rows(batch):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(windows, np.int64))
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
                gone = np.cumsum(change)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((owner, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), stretch), strict=True)], ["owner", "n_removed", "kept_sha256", "removed"])

    cut = result.mapInArrow(last, "owner long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>").dropDuplicates(["owner"])
    all_gone = F.col("copies").isNotNull()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return summary.join(cut, "owner", "left").select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.coalesce("removed", F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>"))).alias("removed"),
    )


def op2_recompression(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).drop("removed")
