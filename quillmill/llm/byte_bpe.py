"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

A byte string's BPE tokens have two properties that make a transducer possible:
the tokens of a prefix only depend on that prefix, and a token sequence is a
BPE encoding exactly if each adjacent pair of it is one.  So the encoder reads
bytes left to right and keeps *configurations*: for each place where a token
that is still being read may have begun, the trie node reached and the tokens
that the prefix before that place has and that are not written yet.  The set of
configurations is the (determinised) state.  A step over a byte is computed once
and remembered; what all configurations agree on is written at once.  A place
stays open only while a vocabulary token could still cross it, so the lookahead
is bounded by the longest token.

Null texts are empty texts; an empty text has no tokens.  Rows are independent:
repeated rows give repeated results and further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.llm.common import Recent

#: Unicode's White_Space characters, which the split pattern's \s stands for.
OTHER_WHITE = "\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITE = "\t-\r " + OTHER_WHITE
ASCII_WHITE = " \t-\r"
STATE_LIMIT = 300_000
PAIR_LIMIT = 600_000
MEMO_LIMIT = 450_000
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank (under ``below``) until none is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best) and (below is None or r < below):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class MergeTransducer:
    """Encodes byte strings by ``ranks``; states are built when first needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                child = self.next[node].get(b)
                if child is None:
                    child = len(self.next)
                    self.next[node][b] = child
                    self.next.append({})
                    self.ends.append(-1)
                node = child
            self.ends[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, (-1,)),)
        self.configs: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens at one end (0: left, 1: right) of ``token`` while it is being merged, first to last."""
        known = self.spines.get((token, side))
        if known is None:
            word = self.token[token]
            known = [token]
            if len(word) > 1:
                # The last merge joined two tokens; they are those that stay if it is not allowed.
                parts = merge_by_rank(word, self.ranks, below=token)
                known = [*self._spine(parts[-side], side), token]
            self.spines[token, side] = known
        return known

    def joins(self, left: int, right: int) -> bool:
        """Do the two tokens stay two when BPE reads them together?

        Merges happen in the order of rank, so follow the tokens on both sides of the
        border as they grow: a merge across it must come before the next one of either
        side (among equal ranks the leftmost is first).
        """
        if left < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIR_LIMIT:
                self.pairs.clear()
            a, b, token, rank = self._spine(left, 1), self._spine(right, 0), self.token, self.ranks.get
            i = j = 0
            while True:
                more_a = a[i + 1] if i + 1 < len(a) else NEVER
                more_b = b[j + 1] if j + 1 < len(b) else NEVER
                across = rank(token[a[i]] + token[b[j]])
                if across is not None and across < more_a and across <= more_b:
                    known = False
                    break
                if more_a == more_b == NEVER:
                    known = True
                    break
                if more_a <= more_b:
                    i += 1
                else:
                    j += 1
            self.pairs[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, read = [], None
        following, ends = self.next, self.ends
        for node, chain in self.configs[state]:
            child = following[node].get(byte)
            if child is None:
                continue
            rank = ends[child]
            if rank >= 0 and read is None and self.joins(chain[-1], rank):
                read = (*chain, rank)
            if following[child]:
                alive.append((child, chain))
        if read is None:
            raise ValueError("the vocabulary is not closed under its own merges")
        alive.append((0, read))
        same, shortest = 1, min([len(chain) for _, chain in alive])
        while same < shortest and len({chain[same] for _, chain in alive}) == 1:
            same += 1
        written = read[1:same]
        # Of a token that is written, only what it may stand next to matters from here on.
        configs = tuple([(node, chain[same - 1 :] if len(chain) == same else (-1, *chain[same:])) for node, chain in alive])
        target = self.number.get(configs)
        if target is None:
            target = self.number[configs] = len(self.configs)
            self.configs.append(configs)
            self.steps.append({})
        found = self.steps[state][byte] = (target, written)
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.configs) > STATE_LIMIT:
            self._forget()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            hop = steps[state].get(byte)
            if hop is None:
                hop = self._step(state, byte)
                steps = self.steps
            state = hop[0]
            if hop[1]:
                out += hop[1]
        out += self.configs[state][-1][1][1:]
        return out


class Utf8Stream:
    """Turns pieces of bytes into text as soon as characters are whole.

    The state is the unfinished character: its bytes so far and how many it needs.
    Broken sequences become U+FFFD, as the codec's "replace" has it.
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        tail = self.open_tail(data)
        cut = len(data) - tail
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back; pieces between ASCII white space are remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.machine = MergeTransducer(read_ranks(ranks_path))
        exact = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(exact).findall
        # A run of ASCII white space always starts a match, unless other white space is around.
        self.chunks = re.compile(f"[{ASCII_WHITE}]*[^{ASCII_WHITE}]+|[{ASCII_WHITE}]+").findall
        self.odd = re.compile(f"[{OTHER_WHITE}]").search
        self.memo, self.parts = Recent(MEMO_LIMIT), Recent(MEMO_LIMIT)
        size = max(self.machine.token) + 1
        self.table = [self.machine.token.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    def _ids(self, text: str) -> bytes:
        memo, found = self.parts, []
        for p in self.pieces(text):
            ids = memo.get(p) or memo.old.get(p)
            if ids is None:
                ids = self.machine.encode(p.encode("utf-8", "surrogatepass"))
                ids = struct.pack(f"<{len(ids)}I", *ids)
                memo.keep(p, ids)
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        self.memo.turn()
        self.parts.turn()
        if self.odd(text):
            return np.frombuffer(self._ids(text), "<u4")
        chunks, memo = self.chunks(text), self.memo
        for c in memo.missing([chunks]):
            memo.keep(c, self._ids(c))
        return np.frombuffer(b"".join(map(memo.__getitem__, chunks)), "<u4")

    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        stream, token, held = Utf8Stream(), self.table.__getitem__, iter(ids)
        while part := list(itertools.islice(held, block)):
            yield stream.feed(b"".join(map(token, part)))
        yield stream.close()

    def digest_row(self, text: str) -> tuple[int, str, str]:
        ids = self.encode(text).tolist()
        names = ",".join(map(self.decimal.__getitem__, ids))
        back = hashlib.sha256()
        for part in self.decode_stream(ids):
            back.update(part.encode("utf-8"))
        return len(ids), hashlib.sha256(names.encode()).hexdigest(), back.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process, kept from task to task."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_path, pattern)
    return _codecs[key]


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc key and ``ids`` of each row."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches):
        machine = codec(ranks_path, pattern)
        for b in batches:
            ids = [machine.encode(x or "").astype("i4") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode_column(ids: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """doc key and ``text`` of each row of ids."""
    schema = f"{key} {ids.schema[key].dataType.simpleString()}, text string"

    def run(batches):
        machine = codec(ranks_path, pattern)
        for b in batches:
            texts = ["".join(machine.decode_stream(x or [])) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return ids.select(key, "ids").mapInArrow(run, schema)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode again, and return the digests of both.

    Ids and texts stay inside the task, so nothing large leaves it.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        machine = codec(ranks_path, pattern)
        for b in batches:
            rows = [machine.digest_row(x or "") for x in b.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
