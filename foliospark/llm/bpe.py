"""A byte-level BPE vocabulary with the whole-token shortcut, for counting and for encoding.

prove() runs the merges on every vocabulary string offline. A string that ends as one token is *whole*: as
the merges within a pre-token see nothing else, that pre-token is this token wherever it occurs. Batches are
then reduced to their distinct pre-tokens; whole ones are looked up, and only the rest is merged.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliospark.llm import kernels as K

#: Merged pre-tokens that a worker remembers before it starts anew; it changes speed alone.
REMEMBERED = 100_000


def default_vocabulary() -> str:
    """The place of the public 50k rank file: FOLIOSPARK_RANKS, or /opt/tokenizers."""
    return os.environ.get("FOLIOSPARK_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of a pre-token: the adjacent pair of the lowest rank is joined, the first of equals, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def is_text(piece: bytes) -> bool:
    try:
        return bool(piece.decode())
    except UnicodeDecodeError:
        return False


def prove(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """The vocabulary strings that are a pre-token and encode alone as one token, with its id."""
    able = [v for v, r in ranks.items() if is_text(v) and merge(v, ranks) == [r]]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in able])]).astype(np.int64)
    ends = K.pre_tokens(np.frombuffer(b"".join(able), np.uint8), offsets)
    n = np.diff(np.searchsorted(ends, offsets, "right"))
    return {v: ranks[v] for v, k in zip(able, n, strict=True) if k == 1}


class Bpe:
    """What a worker holds: the ranks, the whole strings and a Rust encoder for the merges."""

    def __init__(self, ranks: dict[bytes, int], whole: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.whole = pa.array(list(whole), pa.binary())
        self.whole_ids = np.fromiter(whole.values(), np.int64, len(whole))
        self.unproven = {v for v in ranks if v not in whole}
        self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[bytes, list[int]] = {}

    def merged(self, pieces: pa.Array) -> list[list[int]]:
        """The token ids of pre-tokens that aren't whole."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known, encode, data = self.known, self.piece, pieces.buffers()[2]
        at = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, pieces.offset * 4).tolist()
        data = data.to_pybytes() if data is not None else b""
        out = []
        for a, b in zip(at, at[1:], strict=False):
            piece = data[a:b]
            if (found := known.get(piece)) is None:
                # The encoder takes any vocabulary string as one token; an unproven one goes through the merges.
                found = known[piece] = merge(piece, self.ranks) if piece in self.unproven else encode(piece)
            out.append(found)
        return out

    def distinct(self, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The code of every pre-token, the distinct ones, and their whole token or -1."""
        coded = K.strings(buf, ends).dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.whole), -1).to_numpy()
        return coded.indices.to_numpy(), coded.dictionary, np.where(at < 0, -1, self.whole_ids[at])

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, pre-tokens and whole pre-tokens of each text."""
        _, buf, offsets = K.texts_of(column)
        ends = K.pre_tokens(buf, offsets)
        codes, pieces, whole = self.distinct(buf, ends)
        size = np.ones(len(pieces), np.int64)
        rest = np.flatnonzero(whole < 0)
        size[rest] = [len(x) for x in self.merged(pieces.take(pa.array(rest)))]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (size[codes], whole[codes] >= 0)]
        cut = np.searchsorted(ends, offsets, "right")
        return np.diff(sums[0][cut]), np.diff(cut), np.diff(sums[1][cut])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts in a row, and where each text's begin."""
        _, buf, offsets = K.texts_of(column)
        ends = K.pre_tokens(buf, offsets)
        codes, pieces, whole = self.distinct(buf, ends)
        rest = np.flatnonzero(whole < 0)
        lists = self.merged(pieces.take(pa.array(rest)))
        size = np.ones(len(pieces), np.int64)
        size[rest] = [len(x) for x in lists]
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int64)
        one = whole >= 0
        flat[begin[one]] = whole[one]
        if lists:
            mine = size[rest]
            flat[np.repeat(begin[rest] - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())] = np.fromiter((i for x in lists for i in x), np.int64, int(mine.sum()))
        n = size[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begin[codes] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(ends, offsets, "right")]


def save_proof(path: str, where: str) -> None:
    """Proves the vocabulary at ``path`` and keeps the proof: the checksum of the rank file, then a bit a rank, set for whole strings."""
    ranks, whole = loaded(path)
    bits = np.zeros(max(ranks.values()) + 1, bool)
    bits[list(whole.values())] = True
    with open(where, "wb") as f:
        f.write(_checksum(path) + np.packbits(bits).tobytes())


def _checksum(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


@functools.lru_cache(4)
def loaded(path: str, proof: str | None = None) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """The ranks, and the whole strings: from a proof that save_proof() kept, or proved here."""
    ranks = read_ranks(path)
    if proof is None:
        return ranks, prove(ranks)
    with open(proof, "rb") as f:
        data = f.read()
    if data[:32] != _checksum(path):
        raise ValueError(f"{proof} isn't the proof of {path}")
    bits = np.unpackbits(np.frombuffer(data[32:], np.uint8))
    return ranks, {v: r for v, r in ranks.items() if bits[r]}


def on_worker(shared) -> Bpe:
    """The broadcast vocabulary as a Bpe, made once in each Python worker."""
    if (made := getattr(shared, "_made", None)) is None:
        made = shared._made = Bpe(*shared.value)
    return made


if __name__ == "__main__":  # python -m foliospark.llm.bpe RANKS PROOF
    save_proof(*sys.argv[1:3])
