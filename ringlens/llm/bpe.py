"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word is a row of parts and, beside it, the row of merge ranks of adjacent parts. The
smallest rank is searched by scanning the row, the boundary between the two parts is
deleted, and the two neighbouring ranks are refreshed. The words that a group of texts
has for the first time are merged together, as rows of one matrix: every round takes
one boundary out of each word that still has one to take. A scan is quadratic in the
word, so words beyond ``SHORT`` bytes use a heap of ranks over linked parts, which merges
in the same order (lowest rank first, then leftmost).

The vocabulary file is a parameter and is read where the tasks run. Encoded words are
kept in a bounded cache of two generations: when the younger is full it becomes the
elder, and words met again move back, so frequent words stay. No result depends on it.

Defined cases: a null text is empty; an empty text has no ids and the digest
of nothing; strings of the file's special tokens in a text become their ids,
as the library does; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.llm.common import prepare

SHORT = 256
CACHE_WORDS = 200_000
#: Code points of texts that are encoded together (one text at least), and cells of a matrix of words.
GROUP_CHARS, MATRIX = 1 << 19, 1 << 17
_NO_RANK = 1 << 60
#: White space of the pattern, stated as code points so that no engine's own \s decides.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words and numbers stand first: no other alternative but the last two can begin as they do, and these come after them.
PATTERN = (r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: by rule, not by list."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankArrayBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the token that the merge of each rank makes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = self.none = max([*vocab.values(), *self.special.values()]) + 1  # ``none``: no part
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = np.array([a * (size + 1) + b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.int64(_NO_RANK))
        self.pair_ranks = np.append(np.array([*self.ranks.values()], np.int64)[order], np.int64(_NO_RANK))
        self.first_parts, self.made_parts = np.array(self.first, np.int64), np.array(self.made, np.int64)
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        """Scan for the smallest rank, delete that boundary, refresh the ranks at both sides."""
        get, made = self.ranks.get, self.made
        ranks = [get(pair, _NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NO_RANK:
                break
            i = ranks.index(low)
            part = ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((part, ids[i + 1]), _NO_RANK)
            if i:
                ranks[i - 1] = get((ids[i - 1], part), _NO_RANK)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        n = len(ids)
        get = self.ranks.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (r := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # an entry from before a merge
            ids[i], alive[j] = self.made[rank], False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                m = right[k] if k >= 0 else -1
                if m >= 0 and (r := get((ids[k], ids[m]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[m]))
        return [x for x, live in zip(ids, alive) if live]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * (self.none + 1) + b
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], _NO_RANK)

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, one row a word: the steps of ``merge_short`` for all rows at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        ids = np.full((len(words), width), self.none, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.first_parts[np.frombuffer(b"".join(words), np.uint8)]
        ranks, rows = self._ranks_of(ids[:, :-1], ids[:, 1:]), np.arange(len(words))
        out: list[bytes] = [b""] * len(words)
        while True:
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            here = np.arange(len(rows))
            low = ranks[here, at] if width > 1 else np.full(len(rows), _NO_RANK)
            over = low == _NO_RANK
            if over.any():
                done = ids[over]
                parts = done != self.none
                flat, ends = done[parts].astype("<u4").tobytes(), np.cumsum(parts.sum(axis=1)) * 4
                start = 0
                for row, end in zip(rows[over].tolist(), ends.tolist()):
                    out[row] = flat[start:end]
                    start = end
                going = ~over
                ids, ranks, rows, at, low = ids[going], ranks[going], rows[going], at[going], low[going]
                here = np.arange(len(rows))
            if not len(rows):
                return out
            # one boundary less in every row
            width -= 1
            place = np.arange(width)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            ids[here, at] = self.made_parts[low]
            ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= at[:, None]), 1)
            right = at < width - 1
            r, i = here[right], at[right]
            ranks[r, i] = self._ranks_of(ids[r, i], ids[r, i + 1])
            r, i = here[at > 0], at[at > 0]
            ranks[r, i - 1] = self._ranks_of(ids[r, i - 1], ids[r, i])

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        coded = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(coded)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        at, short = 0, int(np.searchsorted(lengths, SHORT, side="right"))
        while at < short:
            # words of like lengths share a matrix
            longest = min(SHORT, int(lengths[at]) * 5 // 4 + 4)
            end = min(short, int(np.searchsorted(lengths, longest, side="right")), at + max(1, MATRIX // longest))
            here = order[at:end].tolist()
            for i, ids in zip(here, self.merge_rows([coded[i] for i in here])):
                out[i] = ids
            at = end
        for i in order[short:].tolist():
            out[i] = np.asarray(self.merge_long([self.first[b] for b in coded[i]]), dtype="<u4").tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a word that several texts have is merged once."""
        words, special = self.words, self.special
        split = [[w for piece in self.cut.split(t) for w in ([piece] if piece in special else words(piece))] if self.cut and self.cut.search(t)
                 else words(t) for t in texts]
        get = self.cache.get
        ids = [[get(w) for w in own] for own in split]
        missed = {w for own, found in zip(split, ids) if None in found for w, x in zip(own, found) if x is None}
        known = {w: x for w in missed if (x := self.elder.get(w)) is not None}
        known |= {w: special[w].to_bytes(4, "little") for w in missed if w in special}
        new = [w for w in missed if w not in known]
        known.update(zip(new, self._merged(new)))
        for own, found in zip(split, ids):
            if None in found:
                found[:] = [known[w] if x is None else x for w, x in zip(own, found)]
        self.cache.update((w, x) for w, x in known.items() if len(w) <= SHORT)
        if len(self.cache) > CACHE_WORDS:
            self.elder, self.cache = self.cache, {}
        return [b"".join(found) for found in ids]

    def encode_in_groups(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order; about ``GROUP_CHARS`` code points are held split at a time."""
        group, chars = [], 0
        for text in texts:
            if group and chars + len(text) > GROUP_CHARS:
                yield from self.encode_all(group)
                group, chars = [], 0
            group.append(text)
            chars += len(text)
        yield from self.encode_all(group)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def encode_documents(df: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text",
                     outputs: str = "digests") -> DataFrame:
    """Encode and decode every whole text.

    ``outputs="digests"``: doc_id, n_tokens, ids_sha256, decoded_sha256.
    ``outputs="ids"``: doc_id, ids (array of int), decoded (the text made from the ids).
    """
    prepare(df.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()
    ids_wanted = outputs == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            keys, rows = batch.column(0), []
            for ids in model.encode_in_groups(t.as_py() or "" for t in batch.column(1)):
                plain = model.decode(ids)
                rows.append((np.frombuffer(ids, "<u4"), plain) if ids_wanted else
                            (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
            cols = list(zip(*rows)) or [()] * (2 if ids_wanted else 3)
            if ids_wanted:
                yield pa.record_batch([keys, pa.array(list(cols[0]), pa.list_(pa.int32())), pa.array(cols[1], pa.string())],
                                      ["doc_id", "ids", "decoded"])
            else:
                yield pa.record_batch([keys, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                      ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, ids array<int>, decoded string" if ids_wanted else f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
