"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenises its documents, cuts those over ``capacity`` into pieces and packs
the pieces best-fit, longest first.  Sequences that are nearly full are final at once;
underfull ones travel on as items.  In each round the underfull bins of about ``FAN_IN``
groups meet in one: whole bins are packed best-fit, and those that found no partner are
opened and their pieces packed best-fit among themselves, where that takes no more bins.
So it goes up a tree of tasks until one group is left, which finishes the rest.

A group is dealt by a hash and holds about ``GROUP_PIECES`` pieces at most, however many
are underfull.  Each group leaves two bins of at most half the capacity at most (two such
bins would have met), so once a round of many groups merges hardly anything, what can
still be merged needs one of those few.  The closing round gives them, and as many of the
other bins with most room, to one task.

What a task of the first stage holds has a bound: words of a slice of text, known words,
and pieces that wait to be packed.  Only ids, lengths and checksums leave it.  Null texts are empty and give one
piece: the end token.  Repeated rows are packed again as rows of their own.  Further
columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import Recent, stored

CAPACITY = 4096
END = 1
NEARLY_FULL = 0.995
FAN_IN = 16
GROUP_PIECES = 200_000
SETTLED = 0.99  # of the bins that came in: a round that leaves more has hardly merged anything
TASK_PIECES = 50_000  # that a task of the first round holds until it packs them
MEMO_LIMIT = 150_000
SLICE_BYTES = 1 << 18  # of text whose words are held at a time
CALL = 2_000  # words that the tokenizer gets at a time

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, residual boolean, task long"


class WordEncoder:
    """Ids of whole texts; words between ASCII white space are encoded once and remembered.

    The tokenizer's normaliser and split never look across white space, so the ids of a
    text are those of its words, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same for words that are runs of letters, which its split leaves whole
        self.letters = Tokenizer.from_file(path)
        self.letters.encode_special_tokens = True
        self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo = Recent(MEMO_LIMIT)
        # tokens that end a run of letters, digits or marks
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the words of about ``SLICE_BYTES`` are held at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        known = self.memo.__getitem__
        for part in _slices(texts, SLICE_BYTES):
            split = [_stems(x.split()) for _, x in part]
            self.memo.turn()
            new = [w.decode("utf-8") for w in self.memo.missing(split)]
            runs, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
            self._encode_runs(runs)
            self._encode_each(others)
            for (k, _), ws in zip(part, split, strict=True):
                out[k].append(b"".join(map(known, ws)))
        return [b"".join(x) for x in out]

    def _encode_each(self, words: list[str]) -> None:
        for i in range(0, len(words), CALL):
            part = words[i : i + CALL]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo.keep(w.encode("utf-8"), struct.pack(f"<{len(e.ids)}I", *e.ids))

    def _encode_runs(self, words: list[str]) -> None:
        """Words of letters alone, many in one text: each ends with its only closing token."""
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, e in zip(parts, self.letters.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):  # letters by another edition of Unicode
                self._encode_each(part)
                continue
            flat, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                self.memo.keep(w.encode("utf-8"), flat[at:end])
                at = end


def _slices(texts: list[str | None], size: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lower-cased texts with their places, in lists of about ``size`` bytes; longer texts are cut before white space."""
    part, held = [], 0
    for k, x in enumerate(texts):
        data, at = (x or "").encode("utf-8").lower(), 0
        while at < len(data):
            gap = _GAP.search(data, at + size)
            end = gap.start() if gap else len(data)
            part.append((k, data[at:end]))
            held, at = held + end - at, end
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def _stems(words: list[bytes]) -> list[bytes]:
    """Words, with a full stop or comma at their end cut off: after a letter or digit it is a token of its own."""
    out = []
    for w in words:
        if w[-1] in _MARKS and len(w) > 1 and w[-2] in _ALNUM:
            out.append(w[:-1])
            out.append(w[-1:])
        else:
            out.append(w)
    return out


_GAP = re.compile(rb"[\x20\x09-\x0D]")
_MARKS = frozenset(b".,")
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and fill of each bin; longest first, each into the fullest bin with room.

    Bins are kept by the room they have left, so a step costs a binary search among
    the at most ``capacity`` sizes of room.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sizes of room that some bin has, sorted
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            b, room = len(fill), capacity
            fill.append(0)
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            if room not in by_room:
                bisect.insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def repack(lengths: np.ndarray, given: np.ndarray, offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces that come in bins (``given``): bins as items first, then the pieces of those left alone."""
    _, at = np.unique(given, return_inverse=True)
    whole, place, fill = best_fit(np.bincount(at, weights=lengths).astype(np.int64), capacity)
    bins, offsets = whole[at], place[at] + offsets
    alone = np.bincount(whole, minlength=len(fill)) == 1
    opened = np.flatnonzero(alone[bins])
    own, at_place, filled = best_fit(lengths[opened], capacity)
    if len(filled) <= int(alone.sum()):
        bins[opened], offsets[opened] = len(fill) + own, at_place
    return np.unique(bins, return_inverse=True)[1], offsets


def _pack(items: pd.DataFrame, capacity: int, task: int, level: int, last: bool) -> pd.DataFrame:
    """Items with their sequence, offset, and whether they go on to the next round; bins stay bins from level 1 on."""
    items = items.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
    lengths = items["length"].to_numpy(np.int64)
    if level:
        bins, offsets = repack(lengths, items["sequence_id"].to_numpy(np.int64), items["offset"].to_numpy(np.int64), capacity)
    else:
        bins, offsets, _ = best_fit(lengths, capacity)
    open_bin = np.bincount(bins, weights=lengths) < NEARLY_FULL * capacity
    # level and task number a bin: 2^5 levels, 2^30 tasks, 2^28 bins a task
    items["sequence_id"] = (level << 58) + (task << 28) + bins
    items["offset"] = offsets
    items["residual"] = False if last else open_bin[bins]
    items["task"] = task
    return items


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * capacity
    parts = [ids[i : i + step] for i in range(0, len(ids), step)]
    return [(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]


def tokenised_and_packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """First round: pieces of each document, packed within the task that tokenised them, about ``TASK_PIECES`` at a time."""

    most = TASK_PIECES

    def packed(ids: list, rows: list, first: int) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        items = pd.DataFrame({"doc_id": pd.array(ids, "Int64")} | {n: np.array(c, np.int64) for n, c in zip(("piece", "start", "length", "ids_crc32"), columns, strict=True)})
        items = _pack(items, capacity, TaskContext.get().partitionId(), 0, False)
        items["piece"] = items["piece"].astype("int32")
        items["sequence_id"] += first
        return pa.RecordBatch.from_pandas(items, schema=_ARROW, preserve_index=False)

    def run(batches):
        machine, close = encoder(tokenizer_path), np.array([end], "<u4").tobytes()
        ids, rows, first = [], [], 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), machine.encode_all(b.column(1).to_pylist()), strict=True):
                for p in cut(x + close, capacity):
                    ids.append(d)
                    rows.append(p)
            if len(rows) >= most:
                yield packed(ids, rows, first)
                first += len(rows)  # a piece makes one bin at most
                ids, rows = [], []
        yield packed(ids, rows, first)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("residual", pa.bool_()), ("task", pa.int64())])


def _merger(capacity: int, level: int, last: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        items = table.drop_columns("up").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return pa.Table.from_pandas(_pack(items, capacity, key[0].as_py(), level, last), schema=_ARROW, preserve_index=False)

    return merge


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return merge_rounds(stored(tokenised_and_packed(docs, tokenizer_path, capacity, end), "pack0"), capacity)


def merge_rounds(rounds: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The tree of merge rounds over the packed pieces of the first round (a stored table)."""
    done, before, groups = [], None, None
    for level in itertools.count(1):
        done.append(rounds.filter(~F.col("residual")))
        left = rounds.filter("residual")
        pieces, bins, tasks = left.agg(F.count("*"), F.count_if(F.col("offset") == 0), F.max("task")).first()
        if not pieces:
            break
        fewer = max(-(-(groups or tasks + 1) // FAN_IN), -(-pieces // group_pieces))
        if groups and groups > 1 and fewer >= groups and bins > SETTLED * before:
            rest, chosen = _closing(left, capacity)
            done += [rest, stored(chosen.withColumn("up", F.lit(0).cast("long")).groupBy("up").applyInArrow(_merger(capacity, level, True), PIECES), "pack-closing")]
            break
        groups, before = fewer, bins
        up = left.withColumn("up", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)))
        rounds = stored(up.groupBy("up").applyInArrow(_merger(capacity, level, groups == 1), PIECES), f"pack{level}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("residual", "task")


def _closing(left: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """What is final as it stands, and what may still be merged: the bins up to half full and as many others with most room."""
    fill = stored(left.groupBy("sequence_id").agg(F.sum("length").alias("fill")), "pack-fill")
    small = fill.filter(F.col("fill") * 2 <= capacity).select("sequence_id")
    large = fill.filter(F.col("fill") * 2 > capacity).orderBy("fill", "sequence_id").limit(small.count()).select("sequence_id")
    chosen = stored(small.unionByName(large), "pack-chosen")
    return left.join(chosen, "sequence_id", "left_anti").select(*left.columns), left.join(chosen, "sequence_id", "left_semi").select(*left.columns)
