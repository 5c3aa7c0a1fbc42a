"""SentencePiece BPE as vectorised merge rounds.

Texts are cut into words where no piece of the vocabulary can cross. All distinct words of a batch lie in one flat numpy
array of symbols, long ones cut again into segments between characters that no piece can hold together, so that a word of
any length is short segments. In each round every segment finds its least pair rank (a segmented minimum), merges that pair at all its
places at once from the left, and the array is compacted; segments without a mergeable pair leave. Where a merge could make
a pair of lower or equal rank, the round merges only the first place, which is what merging one pair at a time does.

Defined cases: null is the empty text; an empty text is the begin and end ids alone; characters outside the vocabulary
become their UTF-8 bytes; repeated rows each get a row; extra columns are ignored; an empty table gives an empty result.
Models must be BPE with byte fallback and an identity normaliser; others are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Texts are encoded in groups of at most about so many characters.
GROUP_CHARS = 2_000_000
#: A task remembers the ids of words of up to so many characters in all, then starts anew.
MEMORY_CHARS = 2_000_000
#: Words of more characters are cut into segments.
LONG_WORD = 32
NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces, merge table and decoding table of a model file's bytes."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE models with byte fallback and an identity normaliser are supported")
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.bos, self.eos, self.unk = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.bytes_at = np.zeros(256, dtype=np.int32)
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        table: list[bytes] = []
        symbol: dict[str, int] = {}
        for i, (text, _, kind) in enumerate(pieces):
            raw = b"" if kind == 3 else text.replace(SPACE, " ").encode()
            if kind == 6:
                raw = bytes([int(text[3:5], 16)])
                self.bytes_at[raw[0]], self.is_byte[i] = i, True
            elif kind == 2:
                raw = " ⁇ ".encode()
            elif kind == 1:
                symbol[text] = i
            table.append(raw)
        self.piece_bytes = np.array(table, dtype=object)
        self.leads = np.array([kind == 1 and text.startswith(SPACE) for text, _, kind in pieces])
        self.n = n = len(pieces)
        normal = sorted({score for _, score, kind in pieces if kind == 1}, reverse=True)
        level = {score: r for r, score in enumerate(normal)}
        rank = np.full(n, NONE, dtype=np.int32)
        for i, (_, score, kind) in enumerate(pieces):
            if kind == 1:
                rank[i] = level[score]
        # characters that occur in pieces without being one are symbols too
        extra = sorted({c for text in symbol for c in text} - set(symbol))
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        names = dict(symbol) | {c: n + k for k, c in enumerate(extra)}
        self.extra = np.array([ord(c) for c in extra], dtype=np.int64)
        for text, i in names.items():
            if len(text) == 1:
                self.chars[ord(text)] = i
        # pieces that repeat the space sign, all of one lowest rank, are put together in one go at the end
        runs = {len(t): i for t, i in symbol.items() if set(t) == {SPACE}}
        ladder_ids = {i for k, i in runs.items() if k > 1}
        lowest = {i for i, r in enumerate(rank) if r == len(normal) - 1} - {runs.get(1)}
        self.ladder = _ladder(runs) if 1 in runs and ladder_ids and ladder_ids == lowest else None
        self.space = runs.get(1, -1)
        if self.ladder is None:
            ladder_ids = set()
        pairs: dict[tuple[int, int], int] = {}
        early = set()
        for text, i in symbol.items():
            if len(text) < 2 or i in ladder_ids:
                continue
            for cut in range(1, len(text)):
                a, b = names.get(text[:cut]), names.get(text[cut:])
                if a is not None and b is not None and a not in ladder_ids and b not in ladder_ids:
                    pairs[a, b] = i
                    for part in (a, b):
                        if part < n and len(pieces[part][0]) > 1 and rank[i] <= rank[part]:
                            early.add(int(rank[part]))
        self.width = np.int64(n + len(extra) + 0x110000)
        # pieces of two characters, and all that stand side by side three at a time in longer ones
        codes = [[names[c] for c in text] for text in symbol]
        wide = int(self.width)
        self.twos = np.array(sorted({a * wide + b for a, b in (c for c in codes if len(c) == 2)}), dtype=np.int64)
        self.threes = np.array(sorted({(a * wide + b) * wide + c for x in codes for a, b, c in zip(x, x[1:], x[2:])}), dtype=np.int64)
        keys = np.array([a * int(self.width) + b for a, b in pairs], dtype=np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 16))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        for key, value, h in zip(keys.tolist(), pairs.values(), self._hash(keys).tolist()):
            while self.slots[h] != -1:
                h = (h + 1) & ((1 << self.bits) - 1)
            self.slots[h], self.values[h] = key, value
        self.rank = np.append(rank, NONE)  # at -1: no such piece
        self.early = np.zeros(len(normal) + 1, dtype=bool)
        self.early[list(early)] = True
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", t) or (len(t) > 1 and "\n" in t) for t in symbol)
        self.word = re.compile(".+", re.S) if crossing else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = a * self.width + b
        at = self._hash(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def segments(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which characters begin a segment of their word: a cut is wherever no piece can hold the characters on both sides.

        A piece over a place is its two characters or holds them with the one before or behind.
        """
        same = word[1:] == word[:-1]
        two = sym[:-1] * self.width + sym[1:]
        joined = _among(two, self.twos)
        if len(sym) > 2:
            three = _among(two[:-1] * self.width + sym[2:], self.threes) & same[:-1] & same[1:]
            joined[:-1] |= three
            joined[1:] |= three
        return np.r_[True, ~(same & joined)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sym = self.chars[points].astype(np.int64)
        sym = np.where(sym < 0, points + (self.n + len(self.extra)), sym)
        whole = np.repeat(np.arange(len(words)), lengths)
        begins = np.ones(len(sym), dtype=bool)
        begins[1:] = whole[1:] != whole[:-1]
        long = np.repeat(lengths > LONG_WORD, lengths)
        if long.any():
            begins[long] = self.segments(sym[long], whole[long])
        word, owner = np.cumsum(begins) - 1, whole[begins]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(sym), -1, dtype=np.int32)
        if len(sym) > 1:
            made[:-1] = np.where(word[1:] == word[:-1], self.merged(sym[:-1], sym[1:]), -1)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            rank = self.rank[made]
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((word[out], sym[out]))
                sym, word, made, rank = sym[~out], word[~out], made[~out], rank[~out]
                if not len(sym):
                    break
                sizes, least = sizes[~over], least[~over]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            chosen = rank == np.repeat(least, sizes)
            place = np.arange(len(sym))
            first = chosen & np.r_[True, ~chosen[:-1]]
            begun = np.maximum.accumulate(np.where(first, place, 0))
            keep = chosen & ((place - begun) % 2 == 0)
            one = self.early[least]
            if one.any():  # only the first place of these words
                head = np.minimum.reduceat(np.where(keep, place, len(sym)), starts)
                keep &= ~np.repeat(one, sizes) | (place == np.repeat(head, sizes))
            at = np.flatnonzero(keep)
            sym[at] = made[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            new = np.zeros(len(sym), dtype=bool)
            new[at] = True
            sym, word, made, new = sym[stay], word[stay], made[stay], new[stay]
            touched = np.flatnonzero(new | np.r_[new[1:], False])
            inner = touched[touched + 1 < len(sym)]
            made[touched] = -1
            inner = inner[word[inner] == word[inner + 1]]
            made[inner] = self.merged(sym[inner], sym[inner + 1])
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._ids(sym[order], owner[word[order]], len(words))

    def _ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        if self.ladder is not None and len(sym):
            space = sym == self.space
            place = np.arange(len(sym))
            first = space & np.r_[True, ~space[:-1] | (word[1:] != word[:-1])]
            within = (place - np.maximum.accumulate(np.where(first, place, 0)))[space]
            run = np.cumsum(first)[space] - 1
            top = self.ladder.shape[1]
            left = np.bincount(run)[run] - within // top * top if len(run) else run
            sym[space] = self.ladder[np.minimum(left, top), within % top]
            stay = sym >= 0
            sym, word = sym[stay], word[stay]
        outside = sym >= self.n
        if outside.any():  # characters without a piece: their bytes
            point = sym - (self.n + len(self.extra))
            own = outside & (point < 0)
            point[own] = self.extra[sym[own] - self.n]
            width = np.ones(len(sym), dtype=np.int64)
            p = point[outside]
            width[outside] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
            raw = "".join(map(chr, p.tolist())).encode("utf-8", "surrogatepass")
            ids = np.repeat(np.where(outside, 0, sym), width).astype(np.int32)
            ids[np.repeat(outside, width)] = self.bytes_at[np.frombuffer(raw, np.uint8)]
            return ids, np.bincount(np.repeat(word, width), minlength=n_words)
        return sym.astype(np.int32), np.bincount(word, minlength=n_words)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control ids are nothing, a leading space sign goes, stray bytes become U+FFFD."""
        parts = self.piece_bytes[ids]
        if self.prefix:
            # the first piece that is not a control, if no byte stands before it
            text = np.flatnonzero((ids != self.bos) & (ids != self.eos))
            if len(text) and self.leads[ids[text[0]]]:
                parts[text[0]] = parts[text[0]][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            out: list[str] = []
            run = bytearray()
            for part, byte in zip(parts, self.is_byte[ids]):
                if byte:
                    run += part
                elif part:
                    out += [_bytes_text(bytes(run)), part.decode()]
                    run.clear()
            return "".join(out) + _bytes_text(bytes(run))


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _bytes_text(raw: bytes) -> str:
    """Byte pieces as text: each byte that begins no valid character is one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _ladder(runs: dict[int, int]) -> np.ndarray | None:
    """What a run of space signs becomes, by its length up to the longest piece: ids at their places, else -1.

    All such pieces have one rank, so merges go from the left. None if longer runs don't begin with the longest piece.
    """
    top = max(runs)

    def merged(n: int) -> list[int]:
        sizes = [1] * n
        while (i := next((i for i in range(len(sizes) - 1) if sizes[i] + sizes[i + 1] in runs), None)) is not None:
            sizes[i : i + 2] = [sizes[i] + sizes[i + 1]]
        return sizes

    table = np.full((top + 1, top), -1, dtype=np.int32)
    for n in range(1, top + 1):
        at = 0
        for size in merged(n):
            table[n, at] = runs[size]
            at += size
    if any(merged(n) != [top] * (n // top) + merged(n % top) for n in range(top, 3 * top + 1)):
        return None
    return table


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file's bytes; a worker keeps it for its next tasks."""
    return Vocabulary(model)


class Encoder:
    """Encodes texts with a bounded memory of words already seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the begin and end ids."""
        if self.chars > MEMORY_CHARS:
            self._forget()
        find, known = self.v.word.findall, self.known
        codes: list[int] = []
        counts = []
        before = len(known)
        for t in texts:
            if t:
                own = [known.setdefault(w, len(known)) for w in find((SPACE if self.v.prefix else "") + t.replace(" ", SPACE))]
                codes += own
                counts.append(len(own))
            else:
                counts.append(0)
        if len(known) > before:
            fresh = list(known)[before:]
            self.chars += sum(map(len, fresh))
            ids, sizes = self.v.encode_words(fresh)
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        code = np.array(codes, dtype=np.int64)
        size = self.sizes[code]
        ends = np.cumsum(self.sizes)
        total = int(size.sum())
        offset = np.cumsum(size) - size
        ids = self.flat[np.repeat(ends[code] - size - offset, size) + np.arange(total)] if total else np.zeros(0, np.int32)
        bounds = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        bos, eos = np.array([self.v.bos], np.int32), np.array([self.v.eos], np.int32)
        return [np.concatenate([bos, ids[bounds[i] : bounds[i + 1]], eos]) for i in range(len(texts))]


def groups(texts: list[str | None], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; null becomes the empty text."""
    out, n = [], 0
    for t in texts:
        out.append(t or "")
        n += len(out[-1])
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


def _over(docs: DataFrame, model_path: str, schema: str, row) -> DataFrame:
    """doc_id and what row(vocabulary, ids) gives for each text. The driver reads the model file, tasks get its bytes."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = docs.sparkSession.createDataFrame([], schema).schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(model.value))
        for batch in slices(batches):
            at = 0
            for texts in groups(batch.column(1).to_pylist()):
                rows = [row(encoder.v, ids) for ids in encoder.encode(texts)]
                columns = [batch.column(0).slice(at, len(texts)), *map(pa.array, zip(*rows))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _digest(v: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of long) of each text."""
    return _over(docs, model_path, "doc_id long, ids array<long>", lambda v, ids: (ids.tolist(),))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, number of ids, and the SHA-256 of the ids and of the text decoded from them."""
    return _over(docs, model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of tokens (doc_id, ids). Null ids are no ids."""
    with open(model_path, "rb") as f:
        model = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for batch in slices(batches):
            texts = [v.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
