r"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text is cut into leaves of LEAF bytes without regard to blanks, the leaves are encoded independently, and
neighbours are joined pair by pair, level by level, up a tree.  A join encodes a window of text around it anew; the
window grows until the outermost unit on either side has the very tokens that the halves gave it.  Units begin at a space that printable
ASCII follows, or that ASCII other than blanks precedes: a new pre-token begins there whatever stands around it,
so what lies outside of a window that agrees can't change.

A stretch over LONG bytes without such a place stays in one leaf.  It is cut into its pre-tokens, and a pre-token over PIECE
characters into a tree of its own, whose joins re-encode windows of tokens, in growing numbers, until the first and last token
are those that the halves had (a token sequence is the BPE encoding of its bytes if every two neighbours
are that of theirs).  LEAF, LONG and PIECE change the work, never the ids.  The leaves of a tree, and the windows of one level, go to the library
in one call, which deals them to its threads.

Within a slice each distinct unit is given to the library once, and some are remembered.  Decoding concatenates the bytes of the vocabulary's tokens.  A slice is encoded again by the plain
path if it did not decode to the input.  Null counts as empty; an empty text has no tokens.  The
special token's string in a text gives the special token, as the library does.  Repeated rows give repeated rows, an empty table none.
Other columns stay as they are; those named like a result (n_tokens, ids_sha256, decoded_sha256, token_ids) are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B

#: bytes of a leaf; of a stretch that has no place to cut; characters of a pre-token's leaf
LEAF, LONG, PIECE = 1024, 2048, 512
#: units on either side of a join that its first window takes
AROUND = 2
#: units whose tokens a task remembers, and units that the library encodes at a time
CACHE_UNITS = 1 << 18
BATCH_UNITS = 1 << 12
OUT_ROWS = 1 << 10
_held: dict[str, Codec] = {}


def byte_chars() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Codec:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = Tokenizer(self.tok.model)  # pre-tokens as they are, in the vocabulary's characters
        chars = byte_chars()
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        raw = [b""] * size
        for t, i in vocab.items():
            raw[i] = t.encode() if t in self.special else bytes(chars[c] for c in t)
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Hashes of known units in order, and where each one's tokens lie in `flat`."""
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    # --- long texts -------------------------------------------------------------------------
    def pieces(self, texts: list[str]) -> list[list[int]]:
        """The tokens of parts of pre-tokens; the library deals them to its threads."""
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encoding of the concatenated bytes of each two encodings."""
        out: list[list[int]] = [[]] * len(pairs)
        todo, w = list(range(len(pairs))), 1
        while todo:
            spans = [(min(w, len(pairs[i][0])), min(w, len(pairs[i][1]))) for i in todo]
            mids = self.pieces(["".join(map(self.tok.id_to_token, pairs[i][0][len(pairs[i][0]) - a :] + pairs[i][1][:b])) for i, (a, b) in zip(todo, spans)])
            left = []
            for i, (a, b), mid in zip(todo, spans, mids):
                x, y = pairs[i]
                if (a == len(x) or mid[0] == x[-a]) and (b == len(y) or mid[-1] == y[b - 1]):
                    out[i] = x[: len(x) - a] + mid + y[b:]
                else:
                    left.append(i)
            todo, w = left, w * 2
        return out

    def tree(self, piece: str) -> list[int]:
        """One pre-token, in the vocabulary's characters."""
        level = self.pieces([piece[i : i + PIECE] for i in range(0, len(piece), PIECE)])
        while len(level) > 1:
            odd = level[-1:] if len(level) % 2 else []
            level = self.join([(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]) + odd
        return level[0] if level else []

    def encode_long(self, text: str) -> list[int]:
        parts = [(text, None)]
        for content, i in self.special.items():
            cut = []
            for s, known in parts:
                if known is not None or content not in s:
                    cut.append((s, known))
                    continue
                for k, x in enumerate(s.split(content)):
                    if k:
                        cut.append((content, i))
                    cut.append((x, None))
            parts = cut
        out: list[int] = []
        for s, known in parts:
            if known is not None:
                out.append(known)
            elif s:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(s):
                    out += self.tree(piece) if len(piece) > PIECE else [t.id for t in self.tok.model.tokenize(piece)]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all units, one after the other, and the count of each."""
        flat, size = [], []
        for i in range(0, len(units), BATCH_UNITS):
            part = units[i : i + BATCH_UNITS]
            got = iter(self.tok.encode_batch_fast([u for u in part if len(u) <= LONG], add_special_tokens=False))
            ids = [next(got).ids if len(u) <= LONG else self.encode_long(u) for u in part]
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((t for x in ids for t in x), np.uint32, int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        flat, size = self.encode_units(units)
        begin = len(self.flat) + np.cumsum(size) - size
        known = np.concatenate((self.known, hashes))
        by = np.argsort(known, kind="stable")
        self.known = known[by]
        self.begin, self.size = np.concatenate((self.begin, begin))[by], np.concatenate((self.size, size))[by]
        self.flat = np.concatenate((self.flat, flat))

    # --- slices -----------------------------------------------------------------------------
    @staticmethod
    def unit_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where units begin, the beginnings of texts among them."""
        n = len(buf)
        prev, nxt = np.empty(n, np.uint8), np.empty(n, np.uint8)
        prev[0], prev[1:] = 32, buf[:-1]
        nxt[-1], nxt[:-1] = 32, buf[1:]
        cut = (buf == 32) & (((nxt > 32) & (nxt < 127)) | ((prev > 32) & (prev < 127)))
        cut[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(cut)

    def encode_slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the texts of a slice, each by itself, as the tokens of its units."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        a = self.unit_starts(buf, off)
        b = np.append(a[1:], n)
        v = (buf.astype(np.uint64) + np.uint64(1)) * B._powers("up", B._R, n)[:n]
        h = B.mix(np.add.reduceat(v, a) * B._powers("down", B._RI, n)[a] + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        uniq, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        if max(len(self.known), len(self.flat) // 4) > CACHE_UNITS:
            self.forget()
        at = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != uniq[inside]
        if new.any():
            spans = zip(a[one[new]].tolist(), b[one[new]].tolist(), strict=True)
            self.learn(uniq[new], [buf[i:j].tobytes().decode() for i, j in spans])
            at = np.searchsorted(self.known, uniq)
        begin, size = self.begin[at], self.size[at]
        k = size[inverse]
        take = np.repeat(begin[inverse] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        total = np.concatenate(([0], np.cumsum(k)))
        counts = np.diff(total[np.searchsorted(a, off)])
        return self.flat[take], counts

    def encode_tree(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the texts of a slice: leaves, and joins of neighbours up to whole texts."""
        n = len(buf)
        leaves = np.concatenate([np.arange(x + LEAF, y, LEAF) for x, y in zip(off[:-1].tolist(), off[1:].tolist()) if y - x > LEAF] or [np.zeros(0, np.int64)])
        if not len(leaves):
            return self.encode_slice(buf, off)
        for _ in range(3):  # not within a character
            leaves = leaves - ((buf[leaves] & 0xC0) == 0x80)
        units = self.unit_starts(buf, off)
        at = np.searchsorted(units, leaves, "right") - 1
        leaves = leaves[np.append(units, n)[at + 1] - units[at] <= LONG]
        edges = np.unique(np.concatenate((off, leaves)))
        flat, counts = self.encode_slice(buf, edges)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        ends = np.searchsorted(edges, off)
        units_list = units.tolist()
        nodes = [[(int(edges[k]), int(edges[k + 1]), parts[k]) for k in range(i, j)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        while True:
            pairs = [(t, k) for t, row in enumerate(nodes) for k in range(0, len(row) - 1, 2)]
            if not pairs:
                break
            joined = dict(zip(pairs, self.join_nodes(buf, units_list, [(nodes[t][k], nodes[t][k + 1]) for t, k in pairs]), strict=True))
            nodes = [[joined[t, k] if (t, k) in joined else row[k] for k in range(0, len(row), 2)] if len(row) > 1 else row for t, row in enumerate(nodes)]
        ids = [row[0][2] if row else np.zeros(0, np.uint32) for row in nodes]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def join_nodes(self, buf: np.ndarray, units: list[int], pairs: list) -> list:
        """Nodes (begin, end, ids) of each two neighbours: `units` are all places where a unit begins."""
        out: list = [None] * len(pairs)
        todo, around = list(range(len(pairs))), AROUND
        while todo:
            spans = []
            for i in todo:
                (a, c, _), (_, b, _) = pairs[i]
                lo, hi = bisect_left(units, c), bisect_left(units, c)
                if lo and units[lo - 1] == c - 1 and not 32 < buf[c - 2] < 127:
                    lo -= 1  # what makes it a beginning stands behind the cut
                lo, hi = lo - around, hi + around
                s = units[lo] if lo >= 0 and units[lo] > a else a
                e = units[hi] if hi < len(units) and units[hi] < b else b
                spans.append((s, e, min([c, *units[lo + 1 : lo + 2]]) if s > a else s, max(c, units[hi - 1]) if e < b else e))
            size = np.cumsum([0] + [e - s for s, e, _, _ in spans])
            flat, counts = self.encode_slice(np.concatenate([buf[s:e] for s, e, _, _ in spans]), size)
            mids, left = np.split(flat, np.cumsum(counts)[:-1]), []
            for i, (s, e, s1, e1), mid in zip(todo, spans, mids):
                (a, c, x), (_, b, y) = pairs[i]
                first, last = self.tail(x, c - s), self.head(y, e - c)
                k = self.head(mid, s1 - s) if s > a else 0
                m = self.tail(mid, e - e1) if e < b else 0
                agree = first is not None and last is not None and k is not None and m is not None
                if agree and k:
                    agree = np.array_equal(mid[:k], x[len(x) - first : len(x) - first + k])
                if agree and m:
                    agree = np.array_equal(mid[len(mid) - m :], y[last - m : last])
                if agree:
                    out[i] = (a, b, np.concatenate((x[: len(x) - first], mid, y[last:])))
                else:
                    left.append(i)
            todo, around = left, around * 2
        return out

    def head(self, ids: np.ndarray, size: int) -> int | None:
        """How many of the first tokens make up `size` bytes; None if a token reaches over."""
        if size >= self.BULK:
            total = np.cumsum(self.length[ids])
            k = int(np.searchsorted(total, size))
            return k + 1 if k < len(total) and total[k] == size else None
        k = 0
        while size > 0 and k < len(ids):
            size -= self.length[ids[k]]
            k += 1
        return k if size == 0 else None

    def tail(self, ids: np.ndarray, size: int) -> int | None:
        return self.head(ids[::-1], size)

    BULK = 256

    def decode(self, ids: np.ndarray) -> np.ndarray:
        k = self.length[ids]
        take = np.repeat(self.start[ids] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return self.bytes[take]

    def encode_texts(self, column: pa.Array):
        """(ids, bytes of the decoded text) for each text."""
        for _, _, buf, off in B.text_slices(column):
            ids, counts = self.encode_tree(buf, off)
            back = self.decode(ids)
            if not np.array_equal(back, buf):
                plain = [self.tok.encode(buf[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in range(len(off) - 1)]
                counts = np.array([len(x) for x in plain], np.int64)
                ids = np.array([t for x in plain for t in x], np.uint32)
                back = self.decode(ids)
            end = np.cumsum(counts)
            length = np.concatenate(([0], np.cumsum(self.length[ids])))
            for i in range(len(counts)):
                a, b = end[i] - counts[i], end[i]
                yield ids[a:b], back[length[a] : length[b]]


def codec(path: str) -> Codec:
    if path not in _held:
        _held[path] = Codec(path)
    return _held[path]


def token_digests(docs: DataFrame, tokenizer: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs' other columns, with n_tokens, ids_sha256 and decoded_sha256, and token_ids if asked for."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")]
    names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def rows(batches):
        c = codec(tokenizer)
        for batch in batches:
            texts, rest_of = batch.column(1), batch.column(0)
            for at in range(0, len(texts), OUT_ROWS):
                out = []
                for i, b in c.encode_texts(texts.slice(at, OUT_ROWS)):
                    out.append((len(i), hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b.tobytes()).hexdigest()) + ((i.astype(np.int32),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([rest_of.slice(at, OUT_ROWS), *[pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)]], names)
        B.release()

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text_col}`").alias("__text"))
    done = packed.mapInArrow(rows, f"row {packed.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *names[1:])


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with the token ids of each text (an empty list for null)."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([i.astype(np.int32) for i, _ in codec(tokenizer).encode_texts(pa.array(texts, pa.string()))], index=texts.index, dtype=object)

    return docs.withColumn(ids_col, ids(F.col(f"`{text_col}`")))


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """tokens with the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        c = codec(tokenizer)
        return pd.Series([None if i is None else c.decode(np.asarray(i, np.int64)).tobytes().decode("utf-8", "replace") for i in ids], index=ids.index, dtype=object)

    return tokens.withColumn(text_col, text(F.col(f"`{ids_col}`")))
