"""Byte-level BPE vocabularies: the cut of a text into pieces that tokenize apart, and cached encoding by the tokenizers library."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of pieces and their values that a Python worker remembers at most, those of pieces and their counts, and the longest piece that is remembered.
CACHE_BYTES = 120_000_000
COUNT_CACHE_BYTES = 30_000_000
LONGEST_KEPT = 200
#: What an entry takes besides its key and value.
ENTRY_BYTES = 180
#: Bytes of text that are worked on together.
GROUP_BYTES = 2_000_000


class Remembered:
    """Values of text pieces, made for many at once and remembered in two generations of half of `most` bytes (CACHE_BYTES): when the newer is full the older is dropped, so what is used often stays."""

    def __init__(self, made: Callable[[list[str]], list], size: Callable[[object], int] = lambda value: 0, most: int | None = None):
        self.made, self.size, self.most = made, size, most
        self.clear()

    def clear(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def values(self, pieces: list[str]) -> list:
        """The values of distinct pieces. Long pieces' values are made each time."""
        if self.held > (CACHE_BYTES if self.most is None else self.most) // 2:
            self.older, self.known, self.held = self.known, {}, 0
        out = list(map(self.known.get, pieces))
        if None not in out:
            return out
        at = [k for k, v in enumerate(out) if v is None]
        sought = [pieces[k] for k in at]
        found = list(map(self.older.get, sought))
        made = iter(self.made([p for p, v in zip(sought, found, strict=True) if v is None]))
        found = [next(made) if v is None else v for v in found]
        for k, value in zip(at, found, strict=True):
            out[k] = value
        sizes = list(map(len, sought))
        if max(sizes) > LONGEST_KEPT:
            short = [n <= LONGEST_KEPT for n in sizes]
            sought, found, sizes = (list(compress(x, short)) for x in (sought, found, sizes))
        self.known.update(zip(sought, found, strict=True))
        self.held += sum(sizes) + ENTRY_BYTES * len(sizes) + sum(map(self.size, found))
        return out


#: White space as str.isspace() has it but for the line end, for Arrow's patterns.
_SPACE = r"\t\f\r\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
#: Signs that end a word, behind a letter or digit: there the vocabulary's pattern starts a token.
SIGNS = ".,;:!?"


def cannot_cut(piece: str) -> bool:
    """Whether a blank beside this piece isn't one blank between two other characters."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def run_of(text: str) -> Iterator[str]:
    """The text in parts that tokenize apart: it is cut before each blank that stands alone between two characters that aren't white space.

    There the vocabulary's pattern starts a token in any case, as a blank joins the letters, digits or signs after it.
    """
    open_part, pieces = None, text.split(" ")
    for k, piece in enumerate(pieces):
        if open_part is None:
            open_part = piece
        elif cannot_cut(piece) or cannot_cut(pieces[k - 1]):
            open_part += " " + piece
        else:
            yield open_part
            open_part = " " + piece
    if open_part:
        yield open_part


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files: visible Latin-1 ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, to which run_of applies."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    apart = not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
    return plain and apart and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class Pieces:
    """Texts cut at each blank and before each line end: distinct pieces, and for each place which one stands there; Arrow does both.

    A line end between two characters that aren't white space is a token, so a
    text can be cut there as at a blank that stands alone. A piece is a word and
    a sign or none after it; distinct words are told apart once more.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        self.codes = coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        self.bounds = bounds - bounds[0]
        self.first = self.bounds[:-1]
        #: By piece: whether it has white space at its ends, but for a first line end, or nothing else; by text: whether such a piece is in it.
        self.odd = pc.match_substring_regex(pieces, rf"^$|^[{_SPACE}]|^\n[\n{_SPACE}]|[\n{_SPACE}]$").to_numpy(zero_copy_only=False)
        self.whole = np.logical_or.reduceat(self.odd[self.codes], self.first) & (np.diff(self.bounds) > 1) if len(texts) else np.zeros(0, bool)
        trimmed = pc.utf8_rtrim(pieces, SIGNS)
        signs = pc.subtract(pc.binary_length(pieces), pc.binary_length(trimmed)).to_numpy(zero_copy_only=False)
        signed = (signs == 1) & pc.match_substring_regex(trimmed, r"[\p{L}\p{N}]$").to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(signed), trimmed, pieces).dictionary_encode()
        self.words: list[str] = listed(words.dictionary)
        #: By piece: its word, and the place of its sign in SIGNS, or -1.
        self.word = words.indices.to_numpy()
        self.sign = np.full(len(pieces), -1)
        last = listed(pc.utf8_slice_codeunits(pieces.filter(pa.array(signed)), -1))
        self.sign[signed] = [SIGNS.index(c) for c in last]
        self.starts = listed(pieces.take(pa.array(self.codes[self.first])))


def taken(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of pool that begin there and have these sizes, one after the other; and where each ends."""
    stops = np.cumsum(sizes)
    return pool[np.repeat(begins - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)], stops


class Encoder:
    """Token ids as the tokenizers library gives them, without added tokens; pieces seen before come from memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.in_pieces = byte_level(json.load(f))
        self.memory = Remembered(self._led, len)
        self.counts = Remembered(self._counted, most=COUNT_CACHE_BYTES)
        self.signs = self._ids(list(SIGNS))
        self.letters = {b: c for c, b in byte_symbols().items()}
        added = {t.content: len(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.widths = np.array([added.get(x, len(x)) for x in names])  # bytes by id: byte-level names have one character each

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def sentence_ends(self) -> np.ndarray:
        """By id: whether the token ends a sentence or a line."""
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return np.array([x.rstrip("\"')").endswith((".", "!", "?", "Ċ")) for x in names])

    def _led(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        """The ids of each word with what leads it, its own line end or else a blank.

        Blanks and letters are one token of the pattern, so the library's merges
        are asked directly. Others: many in one text, as they tokenize apart,
        and cut where the tokens' widths add up to them.
        """
        out = [b""] * len(words)
        blank, merged = self.letters[32], self.tokenizer.model.tokenize
        others = []
        for k, w in enumerate(words):
            if w.isalpha():
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)  # ASCII letters stand for themselves
                out[k] = array("I", [t.id for t in merged(blank + shown)]).tobytes()
            else:
                others.append(k)
        for at in range(0, len(others), at_once):
            group = others[at : at + at_once]
            led = [words[k] if words[k][0] == "\n" else " " + words[k] for k in group]
            raw = self._ids(["".join(led)])[0]
            ends = np.cumsum(self.widths[np.frombuffer(raw, "<u4")])
            cuts = [0, *(4 * (np.searchsorted(ends, np.cumsum([len(w.encode()) for w in led])) + 1)).tolist()]
            for k, a, b in zip(group, cuts, cuts[1:], strict=False):
                out[k] = raw[a:b]
        return out

    def encode_all(self, texts: pa.Array, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has). tail: an id that is appended to each.

        Each distinct piece is looked up once; its ids are then copied to all
        its places by one take. A text's first piece, or the whole text where a
        blank isn't alone, is encoded by itself.
        """
        end = b"" if tail is None else np.array([tail], "<u4").tobytes()
        if not self.in_pieces or not len(texts):
            raw = [x + end for x in self._ids(texts.to_pylist())]
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        cut = Pieces(texts)
        words: list[bytes] = [b""] * len(cut.words)
        plain = np.ones(len(words), bool)
        plain[cut.word[cut.odd]] = False
        at = np.flatnonzero(plain).tolist()
        for k, raw in zip(at, self.memory.values([cut.words[k] for k in at]), strict=True):
            words[k] = raw
        own = self._ids(cut.starts)
        for k in np.flatnonzero(cut.whole).tolist():
            own[k] = b"".join(self._ids(list(run_of(texts[k].as_py()))))
        # by piece: its word's ids, then its sign's
        entries = [*words, *self.signs, b""]
        sizes = np.array([*map(len, entries)], np.int64) // 4
        parts = np.column_stack((cut.word, np.where(cut.sign < 0, len(entries) - 1, len(words) + cut.sign))).ravel()
        ids, stops = taken(np.frombuffer(b"".join(entries), "<u4"), (np.cumsum(sizes) - sizes)[parts], sizes[parts])
        stops = stops[1::2]
        # by place: a piece; at a text's first place, what is its own; after its last, the tail
        sizes = np.concatenate((np.diff(stops, prepend=0), np.array([*map(len, own), 0, len(end)], np.int64) // 4))
        pool = np.concatenate((ids, np.frombuffer(b"".join([*own, end]), "<u4")))
        entry = cut.codes.astype(np.int64)
        if cut.whole.any():
            entry[np.repeat(cut.whole, np.diff(cut.bounds))] = len(sizes) - 2
        entry[cut.first] = len(stops) + np.arange(len(own))
        bounds = cut.bounds[1:]
        if tail is not None:
            entry, bounds = np.insert(entry, bounds, len(sizes) - 1), bounds + np.arange(1, len(bounds) + 1)
        ids, stops = taken(pool, (np.cumsum(sizes) - sizes)[entry], sizes[entry])
        return ids, np.diff(stops[bounds - 1], prepend=0)

    def _counted(self, words: list[str]) -> list[int]:
        """How many ids _led() gives each word."""
        blank, merged = self.letters[32], self.tokenizer.model.tokenize
        out, others = [0] * len(words), []
        for k, w in enumerate(words):
            if w.isalpha():
                out[k] = len(merged(blank + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))))
            else:
                others.append(k)
        for k, raw in zip(others, self._led([words[k] for k in others]), strict=True):
            out[k] = len(raw) // 4
        return out

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """How many ids encode_all() gives each text; the ids themselves are not made, copied or remembered."""
        numbers = lambda texts: [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.in_pieces or not len(texts):
            return np.array(numbers(texts.to_pylist()), np.int64)
        cut = Pieces(texts)
        words = np.zeros(len(cut.words), np.int64)
        plain = np.ones(len(words), bool)
        plain[cut.word[cut.odd]] = False
        words[plain] = self.counts.values([cut.words[k] for k in np.flatnonzero(plain).tolist()])
        signs = np.array([*map(len, self.signs), 0], np.int64) // 4
        there = (words[cut.word] + signs[cut.sign])[cut.codes]
        there[cut.first] = numbers(cut.starts)
        total = np.add.reduceat(there, cut.first)
        for k in np.flatnonzero(cut.whole).tolist():
            total[k] = sum(numbers(list(run_of(texts[k].as_py()))))
        return total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.encode_all(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_pieces() -> None:
    """Drops what this worker's encoders remember. A task does so at its end, as workers live longer than stages."""
    for e in _encoders.values():
        e.memory.clear()
        e.memory.most = None
        e.counts.clear()


def in_groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[slice]:
    """Slices of about most bytes of texts, so that memory follows the group and not the batch."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < len(ends):
        reached = most + (ends[start - 1] if start else 0)
        stop = min(len(ends), int(np.searchsorted(ends, reached)) + 1)
        yield slice(start, stop)
        start = stop
