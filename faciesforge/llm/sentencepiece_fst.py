"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

A model file is compiled into machines. The normaliser is a rewriting transducer: a state for
each prefix of a rule's left side (the model's character map, user-defined pieces, the space),
and at accepting states what is written instead, the longest match first. The piece transducer
has a state for each prefix of a piece; where a piece ends an arc gives its id and weight and
leads back to the start, and characters outside the vocabulary get arcs to the ids of their
bytes. For byte-pair models there is an acceptor over neighbouring pieces too.

An input is composed with them as far as its paths reach, position by position, and the path
of least weight in the tropical semiring (sum along a path, minimum over paths) is read off.
In a unigram model a piece weighs minus its log probability and all neighbours are accepted.
A byte-pair model merges by priority instead, which no sum of piece weights tells, but its
output is told locally: a sequence of pieces is the encoding of a text exactly if each two
neighbours are the encoding of their own text. So there pieces weigh nothing, the acceptor's
arcs weigh nothing for such neighbours and infinity for others, and of the many paths of the
lattice that leaves one of finite weight. Its arcs are expanded when they are first met.

If no piece holds a meta symbol after another character, paths never cross the start of a word:
words are composed one by one, and each worker remembers (bounded) the ids of words it has met.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated
rows and repeated or null ids are encoded row by row; an empty table gives no rows; other
columns are ignored. The meta symbol itself decodes to a space, as the model has it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, held, table
from .tokens import GROUP_BYTES, NO_IDS, Memo, spread

MODEL = "piece_bpe_32k.model"
META = "\N{LOWER ONE EIGHTH BLOCK}"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Added weight of a character outside a unigram vocabulary, and what a user-defined piece weighs less.
PENALTY, BONUS = 10.0, 0.1
#: Words held by Arrow, parts of new words held as Python strings, and the acceptor's arcs.
MEMO_WORDS, MEMO_PARTS, MEMO_CHARS, MEMO_ARCS = 300_000, 150_000, 48, 500_000
#: Characters that may part words, of which one is taken that no text holds.
PARTING = [chr(c) for c in range(1, 9)] + [chr(c) for c in range(0xFDD0, 0xFDF0)]


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[i : i + n]
            i += n


State = dict
"""A state's arcs: character -> state; under ``OUT`` what it gives where it accepts."""
OUT = ""
NO_LINKS: dict[str, float] = {}


def add_path(start: State, text: str, out) -> None:
    for c in text:
        start = start.setdefault(c, {})
    start[OUT] = out


def longest(start: State, text: str, at: int):
    """What the longest path from ``start`` along the text gives, and where it ends; None if there is no path."""
    state, found, n = start, None, len(text)
    while at < n:
        state = state.get(text[at])
        if state is None:
            break
        at += 1
        if OUT in state:
            found = state[OUT], at
    return found


def character_map(raw: bytes) -> Iterator[tuple[str, str]]:
    """The rules of a compiled character map: a double-array trie of left sides, then the right sides, each ended by a zero."""
    if not raw:
        return
    size = struct.unpack("<I", raw[:4])[0]
    units, rights = np.frombuffer(raw, "<u4", size // 4, 4).tolist(), raw[4 + size :]
    child = lambda at, unit: at ^ ((unit >> 10) << ((unit & 512) >> 6))
    todo = [(child(0, units[0]), b"")]
    while todo:
        at, left = todo.pop()
        for c in range(1, 256):
            if (at ^ c) < len(units):
                unit = units[at ^ c]
                if unit & 0x800000FF == c:
                    below = child(at ^ c, unit)
                    if unit >> 8 & 1:
                        right = units[below] & 0x7FFFFFFF
                        yield (left + bytes([c])).decode(), rights[right : rights.index(0, right)].decode()
                    todo.append((below, left + bytes([c])))


class Normaliser:
    """The transducer from raw to normalised text."""

    def __init__(self, spec: dict[int, int | bytes], own: list[str]):
        self.dummy, self.trims, escapes = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if not escapes:
            raise ValueError("only models that write spaces as the meta symbol are compiled")
        self.rules, self.own = {}, {}
        for left, right in character_map(spec.get(2, b"")):
            add_path(self.rules, left, right)
        for piece in own:
            add_path(self.own, piece, piece)
        firsts = sorted({" ", *self.rules, *self.own} - {OUT})
        #: Where a path may start; between such places text is copied. With one arc, from the space, all are taken at once.
        self.starts = None if firsts == [" "] and not self.rules and not self.trims else re.compile("[" + "".join(map(re.escape, firsts)) + "]")

    def step(self, text: str, at: int) -> tuple[str, int]:
        return longest(self.own, text, at) or longest(self.rules, text, at) or (text[at], at + 1)

    def __call__(self, text: str) -> str:
        if self.starts is None:
            return (META if self.dummy and text else "") + text.replace(" ", META)
        out, at, n, after_space = [], 0, len(text), self.trims
        while at < n:
            m = self.starts.search(text, at)
            stop = m.start() if m else n
            if stop > at:
                out.append(text[at:stop])
                after_space, at = False, stop
            if at < n:
                got, at = self.step(text, at)
                if after_space:
                    got = got.lstrip(" ")
                if got:
                    out.append(got.replace(" ", META))
                    after_space = self.trims and got.endswith(" ")
        whole = "".join(out)
        if self.trims:
            whole = whole.rstrip(META)
            if not whole:
                return ""
        return (META if self.dummy and text else "") + whole

    def invert(self, text: str) -> str:
        text = text.replace(META, " ")
        if self.trims:
            return text.lstrip(" ")
        return text[1:] if self.dummy and text.startswith(" ") else text


class Transducer:
    """A compiled model."""

    def __init__(self, raw: bytes):
        self.pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and byte-pair models with the meta symbol in front of words are compiled")
        own = [p for p, _, k in self.pieces if k == USER]
        self.normalise = Normaliser(normaliser, own)
        scores = {p: s for p, s, k in self.pieces if k == NORMAL}
        worst, best = min(scores.values(), default=0.0), max(scores.values(), default=0.0)
        unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE} if trainer.get(35) else {}
        self.unknown, self.scores = unknown, scores
        #: The piece transducer; arcs back to the start give (ids, weight, piece).
        self.start: State = {}
        for i, (p, s, k) in enumerate(self.pieces):
            if k == NORMAL:
                add_path(self.start, p, ((i,), 0.0 if self.kind == BPE else -s, p))
            elif k == USER:
                add_path(self.start, p, ((i,), 0.0 if self.kind == BPE else BONUS - len(p.encode()) * best, p))
        self.outside = 0.0 if self.kind == BPE else PENALTY - worst
        #: In a byte-pair model user-defined pieces stand before anything is merged.
        self.frozen = self.normalise.own if self.kind == BPE and own else None
        self.accepted: dict[str, dict[str, float]] = {}
        self.arcs, self.parts, self.memo = 0, {}, Memo(MEMO_WORDS)
        inner = {(a, b) for p in (*scores, *own) for a, b in zip(p, p[1:])}  # noqa: B905
        self.by_word = not any(b == META and a != META for a, b in inner)
        self.cut = self._cut(inner, own) if self.by_word else re.compile("(?s).+")

    def _cut(self, inner: set[tuple[str, str]], own: list[str]) -> re.Pattern:
        """Cuts normalised text where no piece can reach across."""
        if own:
            return re.compile(f"{META}*[^{META}]+|{META}+")
        after_letter = {b for a, b in inner if a.isalpha()}
        ends = "".join(re.escape(c) for c in "\n.,;:!?*#$%&|()\"'" if c not in after_letter)
        alone = "" if any("\n" in pair for pair in inner) else "\n"
        rest = f"{META}*[^{META}{alone}]+"
        first = f"{META}*[^\\W\\d_]+(?=[{ends}{META}]|\\Z)|" if ends else ""
        return re.compile(f"{first}{rest}" + (f"|{META}*\n" if alone else "") + f"|{META}+")

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text, straight from its definition: best score first, then leftmost."""
        symbols, score = list(text), self.scores.get
        while len(symbols) > 1:
            best, at = -inf, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1], -inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def link(self, left: str, right: str) -> float:
        """The weight of the acceptor's arc between two pieces (after nothing: of the first piece), expanded when first met."""
        known = self.accepted.get(left)
        if known is None:
            known = self.accepted[left] = {}
        found = known.get(right)
        if found is None:
            self.arcs += 1
            if self.arcs > MEMO_ARCS:
                self.arcs = 0
                self.accepted.clear()
                known = self.accepted[left] = {}
            good = self.merged(left + right) == [left, right] if left else self.merged(right) == [right]
            found = known[right] = 0.0 if good else inf
        return found

    def shortest(self, text: str) -> list[int]:
        """The ids on the best path through the composition with ``text``."""
        n, pairs, accepted, start = len(text), self.kind == BPE, self.accepted, self.start
        weight, back, last = [0.0] + [inf] * n, [None] * (n + 1), [""] * (n + 1)  # of each position: its best path's weight, last arc and last piece
        for at in range(n):
            here = weight[at]
            if here == inf:
                continue
            links = accepted.get(last[at], NO_LINKS)
            state, to = start.get(text[at]), at + 1
            while True:  # the arcs from this position: pieces, and a character that is none
                if state is not None and OUT in state:
                    ids, w, piece = state[OUT]
                elif to == at + 1:
                    piece = text[at]
                    ids, w = tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,), self.outside
                else:
                    ids = None
                if ids is not None:
                    if pairs:
                        link = links.get(piece)
                        if link is None:
                            link = self.link(last[at], piece)
                            links = accepted[last[at]]
                        w += link
                    if here + w < weight[to]:
                        weight[to], back[to], last[to] = here + w, (at, ids), piece
                if state is None or to == n:
                    break
                state = state.get(text[to])
                if state is None:
                    break
                to += 1
        out, at = [], n
        while at:
            at, ids = back[at]
            out.append(ids)
        found = []
        for ids in reversed(out):
            if self.bytes or ids[0] != self.unknown or not found or found[-1] != self.unknown:
                found += ids  # unknown characters side by side are one piece
        return found

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if self.frozen:
                found, at, plain = [], 0, 0
                while at < len(part):
                    own = longest(self.frozen, part, at)
                    if own:
                        found += self.shortest(part[plain:at]) + [*longest(self.start, own[0], 0)[0][0]]
                        plain = at = own[1]
                    else:
                        at += 1
                found += self.shortest(part[plain:])
            else:
                found = self.shortest(part)
            ids = np.array(found, "<u4").tobytes()
            if len(part) <= MEMO_CHARS:
                self.parts[part] = ids
        return ids

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one word's after the other's, and how many each has."""
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        part, cut = self._part, self.cut.findall
        found = [b"".join(map(part, cut(w))) for w in words.to_pylist()]
        return (np.frombuffer(b"".join(found), "<u4") if found else NO_IDS), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit."""
        normal = [self.normalise(t) for t in texts]
        parting = next((c for c in PARTING if not any(c in t for t in normal)), None) if self.by_word else None
        if parting is None or not any(normal):
            words = pa.array([self.cut.findall(t) for t in normal], pa.list_(pa.string()))
        else:  # before each first meta symbol, and so before each word but maybe the first
            marked = pc.replace_substring(pc.replace_substring(pa.array(normal, pa.string()), META, parting + META), META + parting, META)
            words = pc.split_pattern(marked, parting)
        ids, counts = self.memo.lay(words.flatten(), self._new)
        flat, ends = ids.tobytes(), (4 * np.r_[0, np.cumsum(counts)][words.offsets.to_numpy()]).tolist()
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if not self.bytes:  # unknown characters side by side are one piece, across words too
            out = [i[np.r_[True, (i[1:] != self.unknown) | (i[:-1] != self.unknown)]].tobytes() if len(i) else b"" for i in (np.frombuffer(o, "<u4") for o in out)]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    @property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, one's after the other's, where each begins and how many it has: the machines turned round."""
        if not hasattr(self, "_surfaces"):
            back = {i: bytes([b]) for b, i in self.bytes.items()}
            parts = [back.get(i) or (b"" if k == CONTROL else " \N{DOUBLE QUESTION MARK} ".encode() if k == UNKNOWN else p.encode()) for i, (p, _, k) in enumerate(self.pieces)]
            length = np.array([len(p) for p in parts], np.int64)
            self._surfaces = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length
        return self._surfaces

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        flat, start, length = self.surfaces
        return self.normalise.invert(flat[spread(start, length, np.frombuffer(ids, "<u4"))].tobytes().decode(errors="replace"))


def transducer(path: str) -> Transducer:
    """The worker's compiled model; its memo lives as long as it is the one in use."""

    def build() -> Transducer:
        with open(path, "rb") as f:
            return Transducer(f.read())

    return held(("pieces", path), build)


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of ``GROUP_BYTES`` characters or one longer text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode_documents(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip[, ids, decoded]) of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [i for some in grouped(texts) for i in model.encode_all(some)]
            back = [model.decode(i) for i in ids]
            cols = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
            if keep:
                cols, names = [*cols, pa.array(ids, pa.binary()), pa.array(back, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids binary, decoded string" if keep else "")
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return encode_documents(table(spark, sf_dir, "documents"), path(MODEL))
