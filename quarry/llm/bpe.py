"""BPE encoding and decoding by speculation and verification.

The text is cut where a run of white space starts; every pre-token of the
byte-level split lies inside one such chunk, so a chunk's ids don't depend on
its neighbours and equal chunks are encoded once per task.  For the pre-tokens
not seen before, a greedy longest match proposes tokens.  A proposal is the
exact result of the merges if every token is what the merges make of its own
bytes and every adjacent pair stays apart when its two tokens are merged as
one word; these checks run over all pairs of a batch as one set of distinct
keys.  Only words that fail are merged exactly.

Chunks that were encoded before are found by a hash and compared byte by byte,
so no collision changes ids.

Defined results: a null text is encoded as an empty one (no ids); added tokens
in a text get their own ids, as the tokenizers library does by default; texts
of any length are encoded whole; a null doc_id stays null; rows are
independent, so ties, repeats and other columns change nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import SPACE, SpanCache, ragged, slices

PAIRS = 2_000_000  # pairs that a task remembers before it starts afresh
# chunks of letters and signs whose split needs no general Unicode classes
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_PLAIN = re.compile(f" ?(?:{_LETTERS}|[0-9]|[!-&(-/:;=-@\\[-`{{-~])+")
_PARTS = re.compile(f" ?{_LETTERS}+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    out, more = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if shown else more))
        more += not shown
    return out


class Bpe:
    """A byte-level BPE model read from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        letters = byte_letters()
        self.letter_of = dict(enumerate(letters))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.longest = max(map(len, self.vocab))
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.text = [""] * size
        pieces = [b""] * size
        for t, i in self.vocab.items():
            self.text[i] = t
            pieces[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        for t, i in self.added.items():
            self.text[i], pieces[i] = t, t.encode()
        self.piece_len = np.fromiter(map(len, pieces), np.int64, size)
        self.piece_off = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.stable = np.full(size, -1, np.int8)
        self.pair, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.failed = self.proposed = 0
        self.chunks = SpanCache()

    # one word

    def merge(self, word: str) -> list[int]:
        """The exact result: the earliest learnt pair is merged first, leftmost first."""
        parts, rank, last = list(word), self.rank, 1 << 60
        ranks = [rank.get(p, last) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == last:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), last)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), last)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match."""
        whole = self.vocab.get(word)
        if whole is not None:
            return [whole]
        out, i, n, get = [], 0, len(word), self.vocab.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                i += 1  # a symbol the vocabulary lacks has no id
        return out

    # many words

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of pre-tokens in the byte-level alphabet."""
        proposals = [self.propose(w) for w in words]
        length = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(length.sum()))
        word = np.repeat(np.arange(len(words)), length)
        singles, merge, text = np.unique(flat), self.merge, self.text
        for t in singles[self.stable[singles] < 0].tolist():
            self.stable[t] = merge(text[t]) == [t]
        bad = np.zeros(len(words), bool)
        bad[word[self.stable[flat] == 0]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        fine = self._apart(flat[near] << 32 | flat[near + 1])
        bad[word[near[~fine]]] = True
        again = np.flatnonzero(bad).tolist()
        self.proposed += len(words)
        self.failed += len(again)
        for i in again:
            proposals[i] = merge(words[i])
        return proposals

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Which pairs of tokens the merges leave as they are when both stand in one word."""
        if len(self.pair) > PAIRS:
            self.pair, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        keys, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pair, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.pair):
            fresh = self.pair[np.minimum(at, len(self.pair) - 1)] != keys
        ends = [(k >> 32, k & 0xFFFFFFFF) for k in keys[fresh].tolist()]
        new = np.fromiter((self.merge(self.text[a] + self.text[b]) == [a, b] for a, b in ends), bool, len(ends))
        self.apart = np.insert(self.apart, at[fresh], new)
        self.pair = np.insert(self.pair, at[fresh], keys[fresh])
        return self.apart[np.searchsorted(self.pair, keys)][where]

    def _chunk_words(self, chunk: bytes) -> list[str | int]:
        """The pre-tokens of a chunk; added tokens as their ids."""
        s, out, at = chunk.decode("utf-8", "replace"), [], 0
        if _PLAIN.fullmatch(s):
            return [w.encode().decode("latin-1").translate(self.letter_of) for w in _PARTS.findall(s)]
        for m in self.split.finditer(s) if self.split else ():
            out += [w for w, _ in self.pre.pre_tokenize_str(s[at : m.start()])] if m.start() > at else []
            out.append(self.added[m[0]])
            at = m.end()
        return out + ([w for w, _ in self.pre.pre_tokenize_str(s[at:])] if at < len(s) else [])

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        parts = [self._chunk_words(c) for c in chunks]
        words = list(dict.fromkeys(w for p in parts for w in p if isinstance(w, str)))
        ids = dict(zip(words, self.encode_words(words)))
        return [[t for w in p for t in (ids[w] if isinstance(w, str) else (w,))] for p in parts]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and each document's offset among them."""
        start = chunk_starts(data, offsets)
        flat, length = self.chunks.lists(data, start, np.append(start[1:], len(data)), self.encode_chunks)
        upto = np.concatenate([[0], np.cumsum(length)])
        return flat, upto[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many id lists and each list's offset among them."""
        length = self.piece_len[ids]
        upto = np.concatenate([[0], np.cumsum(length)])
        return self.pieces[ragged(self.piece_off[ids], length)], upto[offsets]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where documents start, and where ASCII white space starts after a character that isn't white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = SPACE[data]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    odd = at[data[at - 1] >= 0x80]  # Unicode white space continues the run: no cut after it
    if len(odd):
        z = data[odd - 1].astype(np.int64)
        y = data[np.maximum(odd - 2, 0)].astype(np.int64)
        x = data[np.maximum(odd - 3, 0)].astype(np.int64)
        white = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
        white |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
        white |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        white |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
        white |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
        cut[odd[white]] = False
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, digest: bool = False, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids if wanted, and with digest the hashes of the ids and of the text decoded from them."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                flat, at = bpe.encode_slice(data, off)
                out = {"doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array(np.diff(at))}
                if digest:
                    back, to = bpe.decode(flat, at)
                    raw, a, b = flat.astype("<u4").tobytes(), (at * 4).tolist(), to.tolist()
                    text = back.tobytes()
                    out["ids_sha256"] = [hashlib.sha256(raw[p:q]).hexdigest() for p, q in zip(a, a[1:])]
                    out["decoded_sha256"] = [hashlib.sha256(text[p:q].decode("utf-8", "replace").encode()).hexdigest() for p, q in zip(b, b[1:])]
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    columns = ["doc_id long", "n_tokens long", *["ids_sha256 string", "decoded_sha256 string"] * digest, *["ids array<int>"] * ids]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(columns))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the decoded text; null ids decode to an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            rows = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            back, to = bpe.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), at)
            text, b = back.tobytes(), to.tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": [text[p:q].decode("utf-8", "replace") for p, q in zip(b, b[1:])]})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
