"""Sum-of-squares online packing of token streams into fixed windows.

Each partition packs its documents in arrival order. Whole windows are cut off the front of a document; the rest (less
than one window) is placed online. With N[h] windows filled to level h, placing s tokens at level h changes the sum of
squares of N by

    2 * (N[h + s] - N[h]) + 2     into a partly filled window,
    1 - 2 * N[h]                  if it fills a window exactly,
    2 * N[s] + 1                  into a fresh window,

and the level with the smallest change wins (the fullest one on ties). When the partition ends, the windows still open
are topped up: the emptiest give tokens from their ends to the fullest, so at most one window per partition needs
padding. The state is the level array, the open windows and their at most ``window`` ids each.

No shuffle: documents are packed where they are read. A lost task repeats its own split and gives the same pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import read, text_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to the ids that ``tokenizers`` gives with the byte-level BPE file at ``path``, special tokens included.

    The file's vocabulary is read into a table of byte strings, which the faster of the two installed BPE libraries takes; the
    tests compare the ids with those of ``tokenizers``. Only byte-level BPE whose ids follow its merges can be read so.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is no plain byte-level BPE")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # Byte-level files write printable bytes as themselves and the others as the characters from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(map(byte.__getitem__, w)): k for w, k in spec["model"]["vocab"].items() if w not in special}
    bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(bpe.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


class SumOfSquares:
    """The packing state of one partition. Closed pieces are appended to ``done``, with their ids if ``ids`` is set."""

    def __init__(self, window: int, first_sequence: int, ids: bool = False):
        self.window, self.sequence, self.ids = window, first_sequence, ids
        self.count = np.zeros(window + 1, np.int64)  # windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # by level: windows, each a list of pieces
        self.done: list[tuple] = []

    def level_for(self, size: int) -> int:
        n, w = self.count, self.window
        change = 2 * (n[size:] - n[: w + 1 - size]) + 2
        change[n[: w + 1 - size] == 0] = np.iinfo(np.int64).max
        if n[w - size]:
            change[w - size] = 1 - 2 * n[w - size]
        change[0] = 2 * n[size] + 1
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, w, at = len(ids), self.window, 0
        while total - at >= w:
            self.close([[doc_id, at, total, ids[at : at + w]]])
            at += w
        if at == total:
            return
        size = total - at
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append([doc_id, at, total, ids[at:].copy()])
        if level + size == w:
            self.close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), total, self.sequence, offset, *[ids.tolist()] * self.ids))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        rest = [(level, x) for level in range(self.window, 0, -1) for x in self.open[level]]
        i, j = 0, len(rest) - 1
        while i < j:
            (level, full), (least, giver) = rest[i], rest[j]
            piece = giver[-1]
            take = min(self.window - level, len(piece[3]))
            cut = len(piece[3]) - take
            full.append([piece[0], piece[1] + cut, piece[2], piece[3][cut:]])
            piece[3] = piece[3][:cut]
            if not cut:
                giver.pop()
            rest[i], rest[j] = (level + take, full), (least - take, giver)
            i += level + take == self.window
            j -= least == take
        for _, pieces in rest[: j + 1]:
            self.close(pieces)
        self.open, self.count[:] = [[] for _ in self.open], 0


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, separator: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), one row each; with ``ids`` a column ``ids array<int>`` holds their tokens.

    A document is its tokens and then ``separator``. Null and empty texts are the separator alone; a null doc_id stays
    null; repeated rows are packed as often as they occur; other columns are ignored; no rows give no pieces.
    """
    vocabulary = vocabulary or default_vocabulary()
    fields = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")] + [("ids", pa.list_(pa.int32()))] * ids)

    def out(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        state = SumOfSquares(window, TaskContext.get().partitionId() << 32, ids)
        end = np.array([separator], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state.add(doc_id, np.concatenate([encode(text.as_py()), end]))
                if len(state.done) >= 1000:
                    yield out(state.done)
                    state.done = []
        state.finish()
        yield out(state.done)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * ids)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
