"""Exact subword ids for whole texts, at the speed of a word memo.

The two pre-tokenizers used here never let a token run from a non-space character into
white space, so a text may be cut before every space that stands alone and the words encoded
on their own. Natural text repeats its words, so each worker remembers the ids of those it
has met. Arrow tells the words of a group of texts apart, together with the remembered ones,
in one dictionary; only words that are new reach the tokenizer, many at once, and NumPy lays
the ids of all words out again. Texts where words cannot be told by their spaces (other
Unicode white space, or runs of white space where it is kept) go to the tokenizer as they
are, in stretches that end where a cut is safe.

Special strings of the vocabulary that occur in a text are their own ids, as the library has
it; ``specials=False`` makes them ordinary text. Either way the ids are those of encoding the
whole text at once.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._util import held, trim

OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
RUNS = re.compile(rb"[\t-\r ] ")
WHITE_END = "[\\t-\\r ]$"
#: A space where any text may be cut.
SAFE = re.compile("(?<=[!-~]) (?=[!-~])")
SEPARATOR = "\N{BLUE HEART}"
#: Words that the memo keeps, about 40 bytes each, and the longest of them.
MEMO_ENTRIES, MEMO_BYTES = 600_000, 64
#: Bytes of text that are encoded together.
GROUP_BYTES = 8_000_000
#: The same (words, bytes) where a worker's memory is short.
THRIFTY = (300_000, 2_000_000)
#: Words that go to the tokenizer as one text, and characters of a stretch; a result takes some hundred bytes for each id.
RUN_WORDS, STRETCH = 2_000, 1 << 16
#: Stands before a text's first word, which no space precedes.
FIRST = "\x02"
NO_IDS = np.empty(0, "<u4")


class Memo:
    """Words with their ids: word ``i`` has ``length[i]`` of them, one word's after the other's."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.words, self.ids = pa.array([], pa.string()), NO_IDS
        self.length, self.uses, self.last = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def lay(self, words: pa.Array, new: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one word's after the other's, and how many each has; ``new`` tells those of different words not held."""
        before = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()
        ids, length = new(coded.dictionary.slice(before))
        ids, length = np.concatenate([self.ids, ids]), np.r_[self.length, length]
        word = coded.indices.to_numpy()[before:]
        out = ids[spread(np.cumsum(length) - length, length, word)], length[word]
        self.keep(coded.dictionary, ids, length, np.bincount(word, minlength=len(length)))
        return out

    def keep(self, words: pa.Array, ids: np.ndarray, length: np.ndarray, uses: np.ndarray) -> None:
        """Take over a group's dictionary, which begins with the words held before. When there are
        too many, words met once go first, then those not met for longest."""
        self.now += 1
        before = len(self.uses)
        self.last = np.where(uses > 0, self.now, np.r_[self.last, np.zeros(len(uses) - before, np.int64)])
        uses = uses + np.r_[self.uses, np.zeros(len(uses) - before, np.int64)]
        short = pc.binary_length(words).to_numpy() <= MEMO_BYTES
        if len(words) > self.most:
            rank = self.last + (uses > 1) * 8
            bar = np.partition(rank[short], -min(self.most // 2, int(short.sum())))[-min(self.most // 2, int(short.sum()))] if short.any() else 0
            short &= rank > bar if (rank[short] > bar).any() else np.arange(len(short)) < self.most // 2
        if not short.all():
            at = np.flatnonzero(short)
            ids = ids[spread(np.cumsum(length) - length, length, at)]
            words, length, uses, self.last = words.take(pa.array(at)), length[at], uses[at], self.last[at]
        self.words, self.ids, self.length, self.uses = words, ids, length, uses


def spread(start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the ids of these words, one word's after the other's."""
    counts = length[which]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(start) and int(start[-1])) < 2**30 else np.int64
    out = np.repeat((start[which] - (ends - counts)).astype(kind), counts)
    out += np.arange(n, dtype=kind)
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES, specials: bool = True, group: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # texts are cut at special strings before
        self.specials, self.group = specials, group or GROUP_BYTES
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # the memo stands in for it
        self.memo = Memo(entries)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        most = max(self.tokenizer.get_vocab().values()) + 1
        #: Special strings that end a stretch of text, with their ids; any text that may hold others is left to the library.
        plain = {a["content"]: a["id"] for a in added if specials and not any(a[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))}
        rest = [a["content"].lower() for a in added if a["content"] not in plain and not (a["special"] and not specials)]
        self.special = {c.encode(): np.array([i], "<u4").tobytes() for c, i in plain.items()}
        self.marks = re.compile(b"(" + b"|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + b")") if plain else None
        self.others = [c.encode() for c in rest]
        #: White space is kept and each id stands for so many bytes; or it is dropped, ends of words
        #: are marked in the vocabulary, and a separator word has an id of its own.
        self.keeps = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.length, self.ends, self.mark = np.zeros(most, np.int64), np.zeros(most, bool), None
        if self.keeps:
            self.length[list(vocab.values())] = [len(t) for t in vocab]
        else:
            self.ends[list(vocab.values())] = [t.endswith("</w>") for t in vocab]
            own = self._direct([SEPARATOR])[0]
            self.mark = int(own[0]) if len(own) == 1 else None

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.Array, before: str, between: str) -> np.ndarray:
        """The ids of words that stand one after another, in runs of some thousand."""
        offsets = pa.array(np.r_[np.arange(0, len(words), RUN_WORDS), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, words), between)
        out = []
        for text in texts:
            out += self._direct([before + text.as_py()])
            if between.strip():  # the runs are told apart like the words in them
                out.append(np.array([self.mark], "<u4"))
        return np.concatenate(out) if out else NO_IDS

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(0, len(words), RUN_WORDS):
            some = words.slice(i, RUN_WORDS).to_pylist()
            parts += self._direct([w[1:] if w[:1] == FIRST else " " + w for w in some] if self.keeps else some)
        return (np.concatenate(parts) if parts else NO_IDS), np.array([len(p) for p in parts], np.int64)

    def _together(self, words: pa.Array, letters: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that are encoded together and told apart afterwards; None where that fails."""
        if self.keeps:
            ids = self._joined(words, " ", " ")
            ends, at = np.cumsum(self.length[ids]), np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
            last = np.searchsorted(ends, at)
            if not len(ends) or last[-1] != len(ends) - 1 or (ends[last] != at).any():
                return None
            return ids, np.diff(np.r_[-1, last])
        if letters:  # one word each
            ids = self._joined(words, "", " ")
            last = np.flatnonzero(self.ends[ids])
            return (ids, np.diff(np.r_[-1, last])) if len(last) == len(words) and last[-1] == len(ids) - 1 else None
        if self.mark is None:
            return None
        ids = self._joined(words, "", f" {SEPARATOR} ")
        mark = ids == self.mark
        at = np.flatnonzero(mark)
        return (ids[~mark], np.diff(np.r_[-1, at]) - 1) if len(at) == len(words) else None

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words met for the first time, one word's after the other's, and how many each has."""
        n = len(words)
        if self.keeps:  # a text's first word, and what ends in white space, stands alone
            alone = pc.or_(pc.starts_with(words, FIRST), pc.or_(pc.equal(pc.binary_length(words), 0), pc.match_substring_regex(words, WHITE_END)))
            kinds = [np.flatnonzero(alone.to_numpy(zero_copy_only=False)), np.flatnonzero(~alone.to_numpy(zero_copy_only=False)), np.empty(0, np.int64)]
        else:
            alone, letters = (m.to_numpy(zero_copy_only=False) for m in (pc.match_substring(words, SEPARATOR), pc.utf8_is_alpha(words)))
            kinds = [np.flatnonzero(alone), np.flatnonzero(letters), np.flatnonzero(~letters & ~alone)]
        ids, length, order = [], [], []
        for kind, which in enumerate(kinds):
            if len(which):
                some = words.take(pa.array(which))
                got = (self._together(some, kind == 1) if kind else None) or self._one_by_one(some)
                ids.append(got[0])
                length.append(got[1])
                order.append(which)
        if not order:
            return NO_IDS, np.empty(0, np.int64)
        ids, length, order = np.concatenate(ids), np.concatenate(length), np.concatenate(order)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return ids[spread(np.cumsum(length) - length, length, back)], length[back]

    def _ready(self, raw: bytes) -> bytes | None:
        """A text whose words can be told by its spaces alone; None if it goes to the library as it is."""
        if not raw.isascii():
            text = raw.decode()
            if OTHER_SPACE.search(text):
                return None
            if not self.keeps:  # lower case before or after composing is the same where nothing is composed
                low = raw.lower()
                return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode()) else raw
        elif b"\x1c" in raw or b"\x1d" in raw or b"\x1e" in raw or b"\x1f" in raw:
            return None
        if not self.keeps:
            return raw.lower()
        return None if b"\x02" in raw or RUNS.search(raw) else b"\x02" + raw

    def _stretches(self, text: str, step: int) -> list[str]:
        """A text cut where that changes no id, so that no part has to be much longer than ``step``."""
        out, at = [], 0
        while len(text) - at > step:
            cut = SAFE.search(text, at + step)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def _odd(self, raw: bytes) -> bool:
        """Whether a text may hold an added string of another kind, which only the library can tell."""
        return bool(self.others) and any(c in raw.lower() for c in self.others)

    def _whole(self, raw: bytes) -> bytes:
        if self._odd(raw):
            self.tokenizer.encode_special_tokens = not self.specials
            ids = self._direct([raw.decode()])[0].tobytes()
            self.tokenizer.encode_special_tokens = True
            return ids
        return b"".join(self._direct([part])[0].tobytes() for part in self._stretches(raw.decode(), STRETCH))

    def encoded(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """One result for each UTF-8 text (none: empty), a group of texts at a time."""
        group, size = [], 0
        for raw in texts:
            raw = raw or b""
            if len(raw) > 2 * self.group and not self.others:  # a very long text goes in parts of a group's size
                if group:
                    yield from self._group(group)
                    group, size = [], 0
                yield b"".join(self._group([part.encode()])[0] for part in self._stretches(raw.decode(), self.group))
                continue
            if group and size + len(raw) > self.group:
                yield from self._group(group)
                group, size = [], 0
            group.append(raw)
            size += len(raw)
        if group:
            yield from self._group(group)

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        return list(self.encoded(texts))

    def _group(self, texts: list[bytes]) -> list[bytes]:
        marked = [i for i, raw in enumerate(texts) if self.marks and self.marks.search(raw)]
        if not marked:
            return self._plain(texts)
        split = {i: self.marks.split(texts[i]) for i in marked}  # special strings stand at odd places
        parts = iter(self._plain([p for i, raw in enumerate(texts) for p in (split[i][::2] if i in split else [raw])]))
        out = []
        for i in range(len(texts)):
            if i in split:
                out.append(b"".join(self.special[p] if k % 2 else next(parts) for k, p in enumerate(split[i])))
            else:
                out.append(next(parts))
        return out

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without special strings."""
        ready = [None if self._odd(raw) else self._ready(raw) for raw in texts]
        array = pa.array([r for r in ready if r is not None], pa.binary()).cast(pa.string())
        lists = pc.split_pattern(array, " ") if self.keeps else pc.ascii_split_whitespace(array)
        ids, counts = self.memo.lay(lists.flatten(), self._new)
        flat, cuts = ids.tobytes(), (4 * np.r_[0, np.cumsum(counts)][lists.offsets.to_numpy()]).tolist()
        mine = iter([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        del ids, flat, array, lists
        trim()
        return [self._whole(raw) if r is None else next(mine) for raw, r in zip(texts, ready, strict=True)]


def encoder(path: str, specials: bool = True, thrifty: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; its memo lives as long as it is the one in use."""
    entries, group = THRIFTY if thrifty else (MEMO_ENTRIES, GROUP_BYTES)
    return held(("tokenizer", path, specials, thrifty), lambda: Encoder(path, entries, specials, group))
