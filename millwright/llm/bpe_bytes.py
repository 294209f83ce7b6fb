"""Operator 7: byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding.
Storing that token for every prefix gives the whole encoding by walking back
from the end, makes an append exact (only the new prefixes are worked out), and
lets an edit keep all prefixes before it.

A token may follow another when the merges, run on the bytes of both together,
give just these two back; the answer is remembered for each pair.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to no bytes; repeated rows are each encoded; a null ``doc_id`` is passed on.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import Ragged, remembered, runs_of

SCHEMA = "doc_id long, ids array<int>, decoded binary"
#: Splitting before a space and a plain character never cuts a match of the pattern:
#: such a space can only begin one.  Texts with any other space are split with care.
CHUNK = re.compile("(?= [!-~¡-ᙿ])")
MARKS = {*".,;:!?"}
ODD_SPACE = re.compile(" (?![!-~¡-ᙿ])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder over a table of ranks (token bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 250_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            sizes.setdefault(token[-4:], set()).add(len(token))
        #: the last four bytes of a token (all, if fewer) -> sizes over four of the tokens that end so,
        #: longest first, and (size, rank) of the tokens among these bytes' own tails
        self.tails = {
            k: (
                [n for n in sorted(v, reverse=True) if n > 4],
                [(n, ranks[k[-n:]]) for n in range(len(k), 0, -1) if k[-n:] in ranks],
            )
            for k, v in sizes.items()
        }
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.remembered = remembered
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.known: dict[bytes, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.chunks = Ragged(lambda new: [self._chunk(c) for c in new], 700_000)

    def merge(self, piece: bytes) -> list[int]:
        """The plain way: merge the neighbours of lowest rank until none is left."""
        get, none = self.ranks.get, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joins = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while joins and (lowest := min(joins)) != none:
            i = joins.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = get(parts[i] + parts[i + 1], none)
            if i:
                joins[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, first: int, second: int) -> bool:
        if (known := self.pairs.get((first, second))) is None:
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            known = self.merge(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
            self.pairs[first, second] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """As the common libraries do: a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 48:
            return Prefixes(self, piece).ids()
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        start = len(piece)
        while start and piece[:start] not in known:
            start -= 1
        for end in range(start + 1, len(piece) + 1):
            known[piece[:end]] = self.last_of(piece, end, known)
        out, end = [], len(piece)
        while end:
            out.append(known[piece[:end]])
            end -= self.size_of[out[-1]]
        return out[::-1]

    def last_of(self, piece: bytes, end: int, known: dict[bytes, int] | None, last: list[int] | None = None) -> int:
        """The one token that can end the encoding of piece[:end], from those of the shorter prefixes."""
        ranks, pairs, tails = self.ranks, self.pairs, self.tails
        found = tails.get(piece[end - 4 if end > 4 else 0 : end])
        if found is None:
            low = end - 3 if end > 3 else 0
            found = tails.get(piece[low:end]) or tails.get(piece[end - 2 : end]) or tails[piece[end - 1 : end]]
        sizes, short = found
        if sizes:
            long = [(n, t) for n in sizes if n <= end and (t := ranks.get(piece[end - n : end])) is not None]
            short = long + short if long else short
        for size, token in short:
            at = end - size
            if not at:
                if self.reachable(token):
                    return token
                continue
            first = known[piece[:at]] if last is None else last[at - 1]
            if (fits := pairs.get((first, token))) is None:
                fits = self.may_follow(first, token)
            if fits:
                return token
        raise ValueError(f"no token ends the prefix of {end} bytes")

    def _chunk(self, chunk: str) -> list[int]:
        """A chunk is what follows a space; one marked by a zero has no space before it."""
        if chunk.isascii():  # letters, or letters and a mark: the pattern's matches are plain
            if chunk.isalpha():
                return self.encode_piece(b" " + chunk.encode())
            if chunk[-1:] in MARKS and chunk[:-1].isalpha():
                return [*self.encode_piece(b" " + chunk[:-1].encode()), self.ranks[chunk[-1].encode()]]
        chunk = chunk[1:] if chunk[:1] == "\0" else " " + chunk
        out, pieces = [], self.pieces
        for p in self.pattern.findall(chunk):
            if (ids := pieces.get(p)) is None:
                ids = self.encode_piece(p.encode())
                if len(p) <= 48:
                    if len(pieces) > self.remembered:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if ODD_SPACE.search(text):
            return ["\0" + c for c in CHUNK.split(text)]
        chunks = text.split(" ")
        chunks[0] = "\0" + chunks[0]
        return chunks

    def encode(self, text: str) -> np.ndarray:
        return self.chunks.ids(self.cut(text))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        return [x for run in runs_of(texts) for x in self.chunks.batch([self.cut(t) for t in run])]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """last[i]: the token that ends the encoding of the first i + 1 bytes."""

    def __init__(self, bpe: ByteBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        for end in range(start + 1, len(self.piece) + 1):
            self.last.append(self.bpe.last_of(self.piece, end, None, self.last))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace piece[start:end]; returns how many prefixes were worked out anew.

        Prefixes before ``start`` are kept.  A prefix's token depends on the bytes and the tokens of as
        many shorter prefixes as the longest token has bytes; once so many in a row, all of them past
        the edit, end as they did before, the rest does too and is taken over.
        """
        old, rest, reach = self.last, self.piece[end:], self.bpe.longest
        self.piece, self.last = self.piece[:start], old[:start]
        self.append(new)
        at, same = len(self.piece), 0
        self.piece += rest
        for i in range(len(rest)):
            if same >= reach:
                self.last += old[end + i :]
                return len(new) + i
            self.last.append(self.bpe.last_of(self.piece, at + i + 1, None, self.last))
            same = same + 1 if self.last[-1] == old[end + i] else 0
        return len(new) + len(rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker and vocabulary."""
    return remembered((path, pattern), lambda: ByteBpe(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = True, rows: int = 64) -> DataFrame:
    """doc_id, ids, and (if asked for) the bytes that the ids decode to.

    Map-only: each text is encoded where it is read; nothing is shuffled.
    """

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = bpe.encode_all(part["text"].to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                        pa.array([bpe.decode(x.tolist()) if decode else None for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op7_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns from the ids and the decoded bytes."""
    return encode_documents(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
