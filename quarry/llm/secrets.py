"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The base patterns find assignments, access keys and long hexadecimal strings.
The field adds spans: texts are tokens (runs of ``[A-Za-z0-9+/_.=-]``), each
tagged as the beginning or inside of a secret or as outside.  Features are a
token's shape (length, classes of characters, changes between them, longest
run of letters, spread of its characters), the two neighbouring tokens and
the signs between, and features of the file (its share of digits and of
symbols).  It is trained here, by gradient ascent on the exact likelihood
(forward-backward), on sentences made from a seed: secrets of many formats in
assignments, headers and prose, and look-alikes that are none (prices, dates,
addresses, identifiers, long words).

Decoding is exact Viterbi.  A token whose outside score leads by more than all
that transitions could return is outside on every best path; only the runs of
other tokens are decoded.

Defined results: null and empty texts have no spans; patterns and tags cover
whole texts; spans count code points, end exclusive; a tagged span that meets
a base span is dropped, so base spans always stay as they are; rows are
independent, so ties, repeats and other columns change nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import mix, slices, span_hash

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

_INSIDE = np.zeros(256, bool)
_INSIDE[[ord(c) for c in "+/_.=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 other
for _c in range(256):
    _CLASS[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4

DIM = 1 << 13
B, I, O = 0, 1, 2


def _runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set bytes inside documents."""
    n = len(flags)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~flags[:-1], ~flags[1:]
    before[inner] = True
    after[inner - 1] = True
    return np.flatnonzero(flags & before), np.flatnonzero(flags & after) + 1


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the slice."""
    raw, out = data.tobytes(), []
    at = offsets.tolist()
    start, end = _runs(_HEX[data], offsets)
    long = end - start >= 32
    out += [(s, e, 2) for s, e in zip(start[long].tolist(), end[long].tolist())]
    for s, e in zip(at, at[1:]):
        for m in _ASSIGN.finditer(raw, s, e):
            if m.end(2) - m.start(2) >= 8:
                out.append((m.start(), m.end(), 0))
        if raw.find(b"AKIA", s, e) >= 0:
            out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(raw, s, e) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


class Tokens:
    """The tokens of a slice and their hashed features, one array per feature template."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end = _runs(_INSIDE[data], offsets)
        n = len(self.start)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.features: list[np.ndarray] = []
        if not n:
            return
        length = self.end - self.start
        kinds = _CLASS[data]
        sums = {}
        for k in (1, 2, 3, 4):
            c = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kinds == k, out=c[1:])
            sums[k] = c[self.end] - c[self.start]
            if k >= 3:
                self_total = c
                size = np.maximum(np.diff(offsets), 1)
                sums[-k] = np.minimum(9, (self_total[offsets[1:]] - self_total[offsets[:-1]]) * 20 // size)[self.doc]
        change = np.zeros(len(data) + 1, np.int64)
        change[2:] = np.cumsum(kinds[1:] != kinds[:-1])
        turns = change[self.end] - change[self.start + 1]
        step = np.abs(np.diff(data.astype(np.int16), prepend=0))
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(step, out=total[1:])
        rough = (total[self.end] - total[np.minimum(self.start + 1, self.end)]) // np.maximum(length - 1, 1)
        log = np.minimum(np.log2(length).astype(np.int64) * 2 + (length * 2 >= 3 << np.log2(length).astype(np.int64)), 15)
        share = lambda k: np.minimum(sums[k] * 8 // length, 7)
        classes = (sums[1] > 0) | (sums[2] > 0) << 1 | (sums[3] > 0) << 2 | (sums[4] > 0) << 3
        density = np.minimum(turns * 8 // length, 7)
        lower = data | ((kinds == 2) * np.uint8(32))
        word = span_hash(lower, self.start, self.end)
        prev, next_ = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        same = self.doc[1:] == self.doc[:-1]
        prev[1:][same] = word[:-1][same]
        next_[:-1][same] = word[1:][same]
        prev2 = np.zeros(n, np.uint64)
        prev2[1:] = np.where(same, prev[:-1], 0)
        gap = np.zeros(n, np.uint64)
        gap_len = np.zeros(n, np.int64)
        if n > 1:
            gap[1:][same] = span_hash(data, self.end[:-1], self.start[1:])[same]
            gap_len[1:][same] = (self.start[1:] - self.end[:-1])[same]
        gap[gap_len > 6] = 1
        lead = np.zeros(n, np.uint64)
        head = np.minimum(self.start + 4, self.end)
        lead = span_hash(data, self.start, head)
        i64 = lambda x: x.astype(np.uint64)
        shape = i64(log) | i64(classes) << np.uint64(4) | i64(density) << np.uint64(8)
        templates = [
            i64(log),
            i64(classes),
            shape,
            i64(share(3)) | i64(share(2)) << np.uint64(3) | i64(share(1)) << np.uint64(6),
            i64(np.minimum(rough // 4, 15)) | i64(log) << np.uint64(4),
            i64(density) | i64(log) << np.uint64(4),
            lead,
            prev,
            prev2,
            next_,
            gap,
            prev ^ (shape * np.uint64(0x9E3779B97F4A7C15)),
            gap ^ (shape * np.uint64(0x9E3779B97F4A7C15)),
            i64(sums[-3]) | i64(sums[-4]) << np.uint64(4) | i64(log) << np.uint64(8),
        ]
        for t, x in enumerate(templates):
            self.features.append((mix(x + np.uint64((t + 1) * 0x1F3D5B79)) % np.uint64(DIM)).astype(np.int64))


# training


def _sentences(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made texts with the spans of their secrets."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "up": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b64": alnum + "+/", "url": alnum + "-_", "an": alnum}

    def draw(kind: str, size: int) -> str:
        return "".join(sets[kind][i] for i in rng.integers(0, len(sets[kind]), size))

    def secret() -> str:
        k = int(rng.integers(0, 9))
        size = int(rng.integers(20, 48))
        return (
            draw("hex", size), draw("b64", size) + "=" * int(rng.integers(0, 3)), "ghp_" + draw("an", 36), "sk-" + draw("an", size), "AKIA" + draw("up", 16),
            "xoxb-" + draw("an", 12) + "-" + draw("an", 24), "eyJ" + draw("url", 20) + "." + draw("url", 40) + "." + draw("url", 30), draw("url", size), draw("an", size),
        )[k]

    syllables = ["er", "th", "an", "in", "on", "re", "at", "en", "ou", "es", "ti", "ble", "ing", "tion", "le", "de", "que", "sch", "ung", "keit", "os", "la", "ció", "ñas", "é", "über"]

    def word() -> str:
        w = "".join(syllables[i] for i in rng.integers(0, len(syllables), int(rng.integers(1, 6))))
        r = rng.random()
        return w.capitalize() if r < 0.1 else w + rng.choice([".", ",", ""]) if r < 0.3 else w.upper() if r < 0.33 else w

    def plain() -> str:
        k = int(rng.integers(0, 12))
        d = lambda s: "".join(map(str, rng.integers(0, 10, s)))
        return (
            f"{word()}.{d(2)}@mail{d(1)}.example.com", f"+{d(2)} {d(3)} {d(7)}", ".".join(str(x) for x in rng.integers(0, 256, 4)), f"20{d(2)}-0{d(1)}-1{d(1)}", f"https://{word()}.example.com/{word()}/{d(4)}.html",
            d(int(rng.integers(1, 16))), word() + "-" + word(), word() + "_" + word() + "_" + word(), "v" + d(1) + "." + d(2), "".join(word() for _ in range(3)), "/".join(word() for _ in range(4)), word().upper() + "=" + word(),
        )[k]

    keys = ["token", "secret", "password", "api_key", "apikey", "key", "auth", "bearer", "credential", "private_key", "access_key", "client_secret", "pwd", "signature"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 14))):
            r = rng.random()
            if r < 0.12:
                s, key = secret(), str(rng.choice(keys))
                style = int(rng.integers(0, 6))
                before = (f'{key} = "', f"{key}: ", f'"{key}": "', f"Authorization: Bearer ", f"{key.upper()}=", "")[style]
                after = ('"', "", '",', "", "", "")[style]
                if style == 4 and rng.random() < 0.5:
                    before += '"'
                    after = '"'
                elif style == 4:
                    before = before[:-1] + " = "
                text += before
                spans.append((len(text), len(text) + len(s)))
                text += s + after
            elif r < 0.27:
                text += plain()
            else:
                text += word() + str(rng.choice(["", "", "", "", "%%%", " |", "***"]))
            text += str(rng.choice([" ", " ", " ", "\n"]))
        out.append((text, spans))
    return out


@functools.cache
def train(sentences: int = 1500, epochs: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (DIM, 3) and transition weights (4, 3; the last row starts a text)."""
    made = _sentences(np.random.default_rng(seed), sentences)
    texts = pa.array([t for t, _ in made])
    feats, tags, lens = [], [], []
    base = 0
    for i, j, data, off in slices(texts, 1 << 30):
        tok = Tokens(data, off)
        y = np.full(len(tok.start), O)
        for k in range(i, j):
            t, spans = made[k]
            for s, e in spans:
                a, b = off[k - i] + len(t[:s].encode()), off[k - i] + len(t[:e].encode())
                own = np.flatnonzero((tok.start < b) & (tok.end > a))
                y[own] = I
                y[own[:1]] = B
        feats.append(np.stack(tok.features, 1))
        tags.append(y)
        lens.append(np.bincount(tok.doc, minlength=j - i))
    x, y, lens = np.concatenate(feats), np.concatenate(tags), np.concatenate(lens)
    n, width = len(lens), int(lens.max())
    first = np.concatenate([[0], np.cumsum(lens)])[:-1]
    grid = first[:, None] + np.arange(width)
    live = np.arange(width) < lens[:, None]
    grid = np.where(live, grid, 0)
    w, trans = np.zeros((DIM, 3)), np.zeros((4, 3))
    trans[O, I] = trans[3, I] = -20.0  # an inside token follows a secret's token only
    fixed = trans < -10
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    truth = np.zeros((len(y), 3))
    truth[np.arange(len(y)), y] = 1
    prev_y = np.where(np.arange(width)[None, 1:] < lens[:, None], y[grid[:, :-1]], -1)
    want_t = np.zeros((4, 3))
    np.add.at(want_t, (np.full(n, 3), y[first]), 1)
    np.add.at(want_t, (prev_y[prev_y >= 0], y[grid[:, 1:]][prev_y >= 0]), 1)
    for epoch in range(1, epochs + 1):
        e = w[x].sum(1)[grid]
        alpha = np.zeros((n, width, 3))
        alpha[:, 0] = trans[3] + e[:, 0]
        for t in range(1, width):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans[None, :3], axis=1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        beta = np.zeros((n, width, 3))
        pair = np.zeros((4, 3))
        for t in range(width - 2, -1, -1):
            follow = trans[None, :3] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(follow, axis=2), 0)
            p = np.exp(alpha[:, t, :, None] + follow - z[:, None, None])
            pair[:3] += p[live[:, t + 1]].sum(0)
        marginal = np.exp(alpha + beta - z[:, None, None])
        pair[3] = marginal[:, 0].sum(0)
        diff = truth.copy()
        diff[grid[live]] -= marginal[live]
        gw = np.stack([np.bincount(x.ravel(), np.repeat(diff[:, k], x.shape[1]), DIM) for k in range(3)], 1) / n - 1e-4 * w
        gt = (want_t - pair) / n - 1e-4 * trans
        for g, p, m, v in ((gw, w, moment[0], moment[1]), (gt, trans, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        trans[fixed] = -20.0
    return w.astype(np.float32), trans.astype(np.float32)


# decoding


def viterbi(e: np.ndarray, trans: np.ndarray, begins: bool, closes: bool) -> np.ndarray:
    """The best tags of a run of tokens; the run follows and is followed by outside tokens unless it is at a text's ends."""
    score = (trans[3] if begins else trans[O]) + e[0]
    back = np.zeros(e.shape, np.int8)
    for t in range(1, len(e)):
        step = score[:, None] + trans[:3]
        back[t] = step.argmax(0)
        score = step.max(0) + e[t]
    if not closes:
        score = score + trans[:3, O]
    tags = np.zeros(len(e), np.int8)
    tags[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def tagged_spans(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int]]:
    tok = Tokens(data, offsets)
    if not len(tok.start):
        return []
    e = w[tok.features[0]].astype(np.float32)
    for f in tok.features[1:]:
        e += w[f]
    # making one token outside changes two transitions; an inside token after it becomes a beginning, which changes a third
    free = trans[trans > -10]
    most = 3 * float(free.max() - free.min()) + 1e-3
    swap = e[:, I] - e[:, B]
    after = np.zeros(len(e), np.float32)
    after[:-1] = np.maximum(swap[1:], 0)
    open_ = np.maximum(e[:, B], e[:, I]) - e[:, O] + most + after > 0
    at = np.flatnonzero(open_)
    if not len(at):
        return []
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (tok.doc[at[1:]] != tok.doc[at[:-1]])]
    heads = np.flatnonzero(new)
    out = []
    for a, b in zip(at[heads].tolist(), at[np.append(heads[1:], len(at)) - 1].tolist()):
        begins = a == 0 or tok.doc[a - 1] != tok.doc[a]
        closes = b + 1 == len(tok.doc) or tok.doc[b + 1] != tok.doc[b]
        tags = viterbi(e[a : b + 1], trans, begins, closes)
        i = 0
        while i < len(tags):
            if tags[i] == B:
                j = i + 1
                while j < len(tags) and tags[j] == I:
                    j += 1
                out.append((int(tok.start[a + i]), int(tok.end[a + j - 1]), 3))
                i = j
            else:
                i += 1
    return out


def find(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, trans: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind) of each document, in bytes from its start, ordered by start and kind."""
    base = base_spans(data, offsets)
    added = tagged_spans(data, offsets, w, trans)
    if base and added:
        s = np.array([b[0] for b in base])
        reach = np.maximum.accumulate(np.array([b[1] for b in base]))
        k = np.searchsorted(s, np.array([a[1] for a in added])) - 1
        added = [a for a, i in zip(added, k.tolist()) if i < 0 or reach[i] <= a[0]]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    spans = sorted(base + added, key=lambda x: (x[0], x[2], x[1]))
    docs = (np.searchsorted(offsets, np.array([s[0] for s in spans], np.int64), "right") - 1).tolist()
    for (s, e, k), d in zip(spans, docs):
        out[d].append((s - int(offsets[d]), e - int(offsets[d]), k))
    return out


def _points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if raw.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), int(before[e]), k) for s, e, k in spans]


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    w, trans = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                raw, at = data.tobytes(), off.tolist()
                rows = [_points(raw[a:b], s) if s else s for a, b, s in zip(at, at[1:], find(data, off, w, trans))]
                show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)
                out = {"doc_id": batch.column(0).slice(i, j - i)}
                for n, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name] = pa.array([sum(k == n for _, _, k in r) for r in rows], pa.int64())
                out["base_sha256"] = [hashlib.sha256(show([x for x in r if x[2] < 3]).encode()).hexdigest() for r in rows]
                out["spans"] = [show(r) for r in rows]
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by mark; null texts stay null; n_chars follows the text where it is a column."""
    w, trans = train()
    sign = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            texts = batch.column(at_text)
            out = []
            for i, j, data, off in slices(texts):
                raw, at = data.tobytes(), off.tolist()
                for a, b, spans in zip(at, at[1:], find(data, off, w, trans)):
                    own, parts, done = raw[a:b], [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            parts += [own[done:s], sign]
                        done = max(done, e)
                    out.append(b"".join([*parts, own[done:]]).decode("utf-8", "replace") if spans else own.decode("utf-8", "replace"))
            clean = pa.array([None if null else t for t, null in zip(out, texts.is_null().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([clean.cast(batch.schema.field(k).type) if k == at_text else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
