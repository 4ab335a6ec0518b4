"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Reads a tokenizers JSON file of the form: NFC, white space to one space, lower case; a split
into contractions, runs of letters, single digits and runs of the rest; bytes; BPE whose last
symbol of a word carries a suffix; no decoder, so decoding joins tokens by a space.

The leaves of a piece's tree are its adjacent pairs, each with the rank of its merge and its
place; a node holds the smaller of its children, so the root is the leftmost pair of the lowest
rank. A merge changes at most three leaves and the nodes above them. Pieces with equally many
leaves are merged side by side in numpy, each step one merge of every piece that still has one.
A task encodes each distinct word of a chunk once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches
from quillspark.llm.words import SEPARATOR, chunks

_NONE = np.int64(1) << np.int64(62)
_PLACE_BITS = 32
#: Pieces merged side by side at most.
SIDE_BY_SIDE = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairTable:
    """Rank of the merge of two symbols by open addressing; ranks without a merge are -1."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(len(left) * 12).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for rank, key in enumerate(((left.astype(np.int64) << 32) | right).tolist()):
            at = int(self._slot(np.array([key]))[0])
            n = 1
            while self.keys[at] >= 0 and self.keys[at] != key:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + suffix] for c in shown], np.int32)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.full(max([*vocab.values(), *self.added.values()]) + 1, b"", object)
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = t.encode()
        self.pieces = regex.compile(_white(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) + r"|\n")
        self.extra = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    # -- encoding -----------------------------------------------------------------------------

    def split(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of words without white space, and how many each has. A piece that is an added token starts with a line feed."""
        if self.extra and any("<" in w for w in words):
            marked = [self.extra.split(w) if "<" in w else [w] for w in words]
            if any(len(m) > 1 for m in marked):
                flat = [x for m in marked for x in m[::2]]
                pieces, counts = self.split_plain(flat)
                ends, out, n, k = np.cumsum(counts), [], [], 0
                for m in marked:
                    before = len(out)
                    for i, x in enumerate(m):
                        if i % 2:
                            out.append(b"\n" + x.encode())
                        else:
                            out += pieces[ends[k] - counts[k] : ends[k]]
                            k += 1
                    n.append(len(out) - before)
                return out, np.array(n)
        return self.split_plain(words)

    def split_plain(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        text = "\n".join(words) + "\n"
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        found = self.pieces.findall(text.replace("Σ", "σ").lower())
        cut = np.fromiter((x == "\n" for x in found), bool, len(found))
        at = np.flatnonzero(cut)
        return [x.encode() for x in found if x != "\n"], np.diff(at, prepend=-1) - 1

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[data]
        if len(data):
            symbols[starts + sizes - 1] = self.last[data[starts + sizes - 1]]
        counts, out = np.ones(len(pieces), np.int64), symbols
        alive = np.ones(len(data), bool)
        leaves = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64), 0)
        for k in np.unique(leaves[leaves > 0]).tolist():
            rows = np.flatnonzero(leaves == k)
            step = max(1, min(SIDE_BY_SIDE, (1 << 21) // k))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                self._merge(symbols, alive, starts[own], sizes[own], int(k))
        counts = np.add.reduceat(alive, starts).astype(np.int64) if len(data) else counts
        added = [i for i, p in enumerate(pieces) if p[:1] == b"\n"]
        for i in added:  # an added token is one id
            lo = starts[i]
            alive[lo : lo + sizes[i]] = False
            alive[lo], out[lo], counts[i] = True, self.added[pieces[i][1:].decode()], 1
        return out[alive], counts

    def _merge(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leaves: int) -> None:
        """Merge some pieces in place. A leaf is a place with the symbol there and the next one alive."""
        n, width = len(starts), leaves + 1
        place = np.arange(width)
        inside = place < sizes[:, None]
        s = np.where(inside, symbols[np.minimum(starts[:, None] + place, len(symbols) - 1)], -1).ravel()
        nxt = np.where(place + 1 < sizes[:, None], place + 1, -1).ravel()
        prv = np.broadcast_to(place - 1, (n, width)).copy().ravel()
        live = inside.ravel().copy()
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        pair = np.flatnonzero(nxt >= 0)
        rank = self.pairs(s[pair], s[pair + 1])
        row, at = np.divmod(pair, width)
        ok = rank >= 0
        tree[row[ok], leaves + at[ok]] = (rank[ok].astype(np.int64) << _PLACE_BITS) | at[ok]
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        tree = tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree[rows * (2 * leaves) + 1]
            rows, root = rows[root < _NONE], root[root < _NONE]
            if not len(rows):
                break
            base, top = rows * width, rows * (2 * leaves)
            p = root & ((1 << _PLACE_BITS) - 1)
            left = base + p
            q = nxt[left]
            right = base + q
            s[left] = self.merged[root >> _PLACE_BITS]
            live[right] = False
            after, before = nxt[right], prv[left]
            nxt[left] = after
            has = after >= 0
            prv[base[has] + after[has]] = p[has]
            self._set(tree, top[q < leaves], q[q < leaves], np.full(int((q < leaves).sum()), _NONE), leaves)
            new = np.full(len(rows), _NONE)
            r = self.pairs(s[left[has]], s[base[has] + after[has]])
            new[has] = np.where(r >= 0, (r.astype(np.int64) << _PLACE_BITS) | p[has], _NONE)
            self._set(tree, top, p, new, leaves)
            had = before >= 0
            r = self.pairs(s[base[had] + before[had]], s[left[had]])
            self._set(tree, top[had], before[had], np.where(r >= 0, (r.astype(np.int64) << _PLACE_BITS) | before[had], _NONE), leaves)
        live, s = live.reshape(n, width), s.reshape(n, width)
        spot = (starts[:, None] + place)[inside]
        alive[spot] = live[inside]
        symbols[spot] = s[inside]

    @staticmethod
    def _set(tree: np.ndarray, top: np.ndarray, leaf: np.ndarray, value: np.ndarray, leaves: int) -> None:
        """A point update: set a leaf of each row's tree and renew the nodes above it."""
        node = leaf + leaves
        tree[top + node] = value
        while leaves > 1:
            node = node >> 1
            at = top + node
            tree[at] = np.minimum(tree[at + node], tree[at + node + 1])
            leaves >>= 1

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.split(words)
        ids, per = self.encode_pieces(pieces)
        ends = np.append(0, np.cumsum(per))
        cuts = np.append(0, np.cumsum(counts))
        return ids, np.diff(ends[cuts])

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """The tokens' strings, joined by a space."""
        return b" ".join(self.tokens[np.asarray(ids, np.int64)]).decode()


def _white(pattern: str) -> str:
    """\\s as Unicode's white space alone."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        for c in chunks(batch.column("text")):
            sizes = c.ends - c.starts
            plain = c.data[~SEPARATOR[c.data]]
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]).dictionary_encode()
            kinds, index = words.dictionary.cast(pa.large_string()).to_pylist(), words.indices.to_numpy()
            ids, counts = v.encode_words(kinds) if kinds else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            begins = np.cumsum(counts) - counts
            n = counts[index]
            ends = np.append(0, np.cumsum(n))
            flat = ids[np.repeat(begins[index] - ends[:-1], n) + np.arange(ends[-1])].astype("<u4")
            tokens = v.tokens[ids].tolist()
            texts = [b" ".join(tokens[b : b + k]) + b" " if k else b"" for b, k in zip(begins.tolist(), counts.tolist(), strict=True)]
            joined = pa.array(texts, pa.large_binary()).take(pa.array(index)) if kinds else pa.array([], pa.large_binary())
            _, places, raw = joined.buffers()
            places = np.frombuffer(places, np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
            raw = memoryview(raw) if raw is not None else memoryview(b"")
            token_at, text_at = ends[c.bounds], places[c.bounds]
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            blobs = [bytes(view[4 * a : 4 * b]) for a, b in zip(token_at[:-1].tolist(), token_at[1:].tolist(), strict=True)]
            shown = [bytes(raw[a : max(a, b - 1)]) for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
            rest = batch.slice(c.first, c.rows).drop_columns(["text"])
            new = [pa.array(np.diff(token_at), pa.int64()), pa.array(blobs, pa.binary()), pa.array(shown, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], names=[*rest.schema.names, "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document.

    docs has doc_id and text; other columns are ignored, every row keeps its row. ids are the
    tokens of the whole text as little-endian unsigned 32-bit integers, without special tokens of
    the encoder's own; decoded joins the tokens' strings by a space. A null text counts as empty
    and has no tokens. path is the tokenizer's file on every executor.
    """
    bound_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encode(it, path), schema)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    found = encode(docs, path or word_bpe_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
