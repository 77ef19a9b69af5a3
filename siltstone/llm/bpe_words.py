"""Word-cached BPE encoding with the ``tokenizers`` library.

A BPE tokenizer first cuts a text into pre-tokens and then merges within each.
Pre-tokens never cross the boundaries used here, so Arrow finds a batch's
distinct white-space words and cuts marks off their ends, and only pre-tokens
that the cache lacks reach the library's model. The cache is a column of
pre-tokens beside one array of their ids, searched a column at a time. Whatever
this does not cover (a special token's own text, rare code points, control
separators, runs of white space) goes through ``Tokenizer.encode`` itself with
the library's defaults; tests compare both ways.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Words of code points below this take the short way.
PLAIN = "ɐ"
#: A unit of one word: a newline before it, marks before it, letters, marks behind it. Without an apostrophe before a word none begins a contraction.
REGULAR = r"^(?P<n>\n?)(?P<a>[!-&(-/:-@\[-`{-~]*)(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<z>[!-/:-@\[-`{-~]*)$"
#: Texts that hold these take the library's way: separators that libraries see differently, and white space in a row.
ODD = "[\\x1c-\\x1f]"
DOUBLE = "[\\s\\v\\x85\\pZ]{2}|[\\x1c-\\x1f]"
#: Before a unit in the cache that is not one pre-token; no text of the short way holds it.
WHOLE = "\x1c"

#: The byte-level pre-tokenization pattern of the public 50k vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens in each of the cache's two generations, about 30 bytes each.
CACHE_ENTRIES = 800000
#: Bytes of text that are encoded at once; a longer text alone.
SLICE = 12 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache:
    """Ids by pre-token in two bounded generations: a full one becomes the old one, whose entries come back when used."""

    def __init__(self, make, dtype: np.dtype, entries: int):
        self.make, self.entries = make, entries
        self._empty = (pa.array([], pa.string()), np.zeros(0, dtype), np.zeros(0, np.int64))
        self.new = self.old = self._empty

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct keys: an array of ids, and where each key's ids start and end in it."""
        names, ids, ends = self.new
        at = pc.index_in(keys, names)
        if at.null_count:
            lost = keys.filter(at.is_null())
            more, more_sizes = self._missing(lost)
            names = pa.concat_arrays([names, lost])
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, (ends[-1] if len(ends) else 0) + np.cumsum(more_sizes)])
            place = at.fill_null(-1).to_numpy().astype(np.int64)
            place[place < 0] = np.arange(len(self.new[0]), len(names))
        else:
            place = at.to_numpy().astype(np.int64)
        stop = ends[place]
        start = np.where(place > 0, ends[place - 1], 0)
        self.new = (names, ids, ends)
        if len(names) > self.entries:
            self.new, self.old = self._empty, self.new
        return ids, start, stop

    def _missing(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for keys that the new generation lacks."""
        names, ids, ends = self.old
        at = pc.index_in(keys, names)
        made, made_sizes = self.make(keys.filter(at.is_null()))
        found = at.is_valid().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy()[found]
        stop = ends[place]
        start = np.where(place > 0, ends[place - 1], 0)
        sizes = np.zeros(len(keys), np.int64)
        sizes[found], sizes[~found] = stop - start, made_sizes
        out = np.zeros(sizes.sum(), ids.dtype)
        of_old = np.repeat(found, sizes)
        out[of_old], out[~of_old] = ids[_spans(start, stop)], made
        return out, sizes


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The places from each start to its stop, one after the other."""
    n = stop - start
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class WordBpe:
    """Ids as arrays of ``dtype``, the narrowest little-endian type for the vocabulary."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._letters = byte_letters()
        self._model = self.tokenizer.model
        self._cache = _Cache(self._make, self.dtype, entries)
        self._special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
        as_is = not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        pre = spec["pre_tokenizer"]
        self._kind = ""
        if as_is and pre["type"] == "Sequence" and spec["normalizer"]:
            self._pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
            self._kind = "words"
        elif as_is and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and not spec["normalizer"]:
            self._pattern = regex.compile(BYTE_PATTERN)
            self._kind = "spaced"

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _pieces(self, unit: str) -> list[str]:
        """The pre-tokens of a unit that REGULAR does not cover."""
        if self._kind == "words":
            return self._pattern.findall(self.tokenizer.normalizer.normalize_str(unit))
        return self._pattern.findall(unit)

    def _make(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new keys in one array, and how many each has."""
        out: list[int] = []
        sizes: list[int] = []
        tokenize, letters = self._model.tokenize, self._letters
        whole = pc.starts_with(keys, WHOLE).to_numpy(zero_copy_only=False)
        plain = keys.filter(pa.array(~whole)).to_pylist()
        # no key of one pre-token but the newline itself holds a newline; its letter parts the others
        mapped = iter("\n".join(x for x in plain if x != "\n").encode().decode("latin-1").translate(letters).split(letters[10]))
        units = iter(keys.filter(pa.array(whole)).to_pylist())
        ones = iter(plain)
        for is_unit in whole.tolist():
            before = len(out)
            if not is_unit:
                piece = letters[10] if next(ones) == "\n" else next(mapped)
                out.extend([t.id for t in tokenize(piece)])
            elif max(unit := next(units)[1:], default="") >= PLAIN:
                out.extend(self.tokenizer.encode(unit, add_special_tokens=False).ids)
            else:
                for piece in self._pieces(unit):
                    out.extend([t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))])
            sizes.append(len(out) - before)
        return np.array(out, self.dtype), np.array(sizes, np.int64)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct units: an array of ids, and where each unit's ids start and end in it."""
        parts = pc.extract_regex(units, REGULAR)
        regular = parts.is_valid()
        newline, before, word, behind = (pc.if_else(regular, pc.struct_field(parts, c), "") for c in "nawz")
        if self._kind == "words":
            word = pc.utf8_lower(word)
            whole = pc.binary_join_element_wise(WHOLE, units, "")
        else:
            # the space before a unit is its first pre-token's own, but for one behind a newline
            space = pc.if_else(pc.or_(pc.equal(newline, "\n"), pc.invert(regular)), "", " ")
            marked = pc.not_equal(before, "")
            word = pc.binary_join_element_wise(pc.if_else(marked, "", space), word, "")
            before = pc.if_else(marked, pc.binary_join_element_wise(space, before, ""), "")
            whole = pc.binary_join_element_wise(WHOLE, pc.if_else(pc.starts_with(units, "\n"), "", " "), units, "")
        word = pc.if_else(regular, word, whole)
        coded = pa.concat_arrays([newline, before, word, behind]).dictionary_encode()
        ids, start, stop = self._cache.find(coded.dictionary)
        code = coded.indices.to_numpy().reshape(4, len(units)).T.ravel()
        start, stop = start[code], stop[code]
        ids = ids[_spans(start, stop)]
        ends = np.cumsum(stop - start)[3::4]
        return ids, np.concatenate([np.zeros(1, np.int64), ends])[:-1], ends

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in one array, and the n + 1 boundaries of its rows. Null: empty."""
        texts = pc.fill_null(texts, "")
        ids, ends, n = [], [np.zeros(1, np.int64)], 0
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=0)) if len(sizes) else []
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            if b > a:
                part, at = self._encode_slice(texts.slice(a, b - a))
                ids.append(part)
                ends.append(at[1:] + n)
                n += len(part)
        return np.concatenate(ids) if ids else np.zeros(0, self.dtype), np.concatenate(ends)

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        shift = 0
        if self._kind == "words":
            odd = pc.match_substring_regex(texts, f"{ODD}|{self._special}" if self._special else ODD)
        elif self._kind == "spaced":
            # a newline before each text stands for "no space before the first word"; its id goes below
            marked = pc.binary_join_element_wise("\n", texts, "")
            odd, shift = pc.match_substring_regex(marked, f"{DOUBLE}|{self._special}" if self._special else DOUBLE), 1
            marked = pc.replace_substring(marked, "\n", " \n")
        else:
            odd = pa.array(np.ones(len(texts), bool))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd_at) == len(texts):
            rows = [self.direct(t) for t in texts.to_pylist()]
            return self._joined(rows)
        units = pc.utf8_split_whitespace(texts) if self._kind == "words" else pc.split_pattern(marked, " ")
        coded = units.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        table, start, stop = self._units(coded.dictionary)
        start, stop = start[codes], stop[codes]
        if shift:  # the empty piece before the newline
            heads = units.offsets.to_numpy()[:-1] - units.offsets[0].as_py()
            stop[heads] = start[heads]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(stop - start)])
        ids = table[_spans(start, stop)]
        bounds = ends[units.offsets.to_numpy() - units.offsets[0].as_py()]
        if shift:
            keep = np.ones(len(ids), bool)
            keep[bounds[:-1]] = False
            ids, bounds = ids[keep], bounds - np.arange(len(bounds))
        if not len(odd_at):
            return ids, bounds
        special = set(odd_at.tolist())
        return self._joined([self.direct(t) if i in special else ids[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts.to_pylist())])

    def _joined(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.zeros(0, self.dtype)]), np.cumsum([0, *map(len, rows)])


def ended(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and boundaries with an end id behind each row."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


_held: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """This process's encoder for a vocabulary; reused by later tasks."""
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _held[path] = WordBpe(path)
    return _held[path]
