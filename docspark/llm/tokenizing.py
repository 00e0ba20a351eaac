"""Token ids of whole texts through the tokenizers library.

Prose repeats its words, so a batch of texts is split at single spaces and each distinct part is taken once: Arrow
splits and numbers the parts and takes them apart into words and marks, numpy puts the ids back in place. A bounded table
keeps the words across batches: their texts in one Arrow array and their ids in another, since an object for each word takes several times the memory.
The cuts are places where the vocabulary's own pre-tokenizer always cuts, so the joined ids equal those of the
whole text. New words of Latin-1 letters go to the library's BPE model together; a part of any other form is split by the same pattern
here or, with other characters or where it may hold a special token, goes through the whole library. Texts with other than single white space between words take a slower way with the same result.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space with the word after it; the last white space stands alone.
_SPACED = re.compile(r"\s*\S+|\s+")
# Python counts these as white space, the tokenizers' patterns don't.
_SEPARATORS = "[\x1c-\x1f]"
_BORDER = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
_OTHER = re.compile("[^\x00-\xff]|<\\|")

# The Latin-1 part of Unicode's letters, numbers and white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_KEEPS_SPACE = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_MARKS = r"[!-&(-/:-@\[-`{-~]+"
_WORDS = rf"\A(?P<first> ?[{_L}]+)(?P<marks>{_MARKS})?(?:\n(?P<second>[{_L}]+)(?P<more>{_MARKS})?)?\z"  # of Arrow
_DROPS_SPACE = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class _Pieces(dict):
    """Ids of pieces of any form; longer ones than 64 characters aren't kept."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.drops_space, self.letters = Tokenizer.from_file(path), drops_space, _byte_letters()
        model = self.library.model
        model._resize_cache(0)  # words come once, the tables keep them
        self.tokenize = model.tokenize
        self.cut = (_DROPS_SPACE if drops_space else _KEEPS_SPACE).findall

    def whole(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 64:
            return self.whole(piece)
        self[piece] = ids = self._new(piece)
        return ids

    def _new(self, piece: str) -> bytes:
        if ("<|" in piece) if piece.isascii() else _OTHER.search(piece):
            return self.whole(piece)
        words = self.cut(piece.lower() if self.drops_space else piece)
        if len(words) == 1 and words[0] == piece:
            return array.array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return b"".join(map(self.__getitem__, words))


class _Words:
    """Ids of words of Latin-1 letters, which may begin with a space.

    A full table keeps the words that were asked for again since it was full the last time, at most half of its room; the rest goes.
    """

    def __init__(self, pieces: _Pieces, limit: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.drops_space, self.limit, library = pieces.drops_space, limit, pieces.library
        self.library = Tokenizer(library.model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters, names = pieces.letters, [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
        self.border = np.array([x.endswith("</w>") if self.drops_space else x.startswith(letters[32]) for x in names])
        self.feed = library.token_to_id(letters[10])
        self.letters = np.array([ord(letters[i]) for i in range(256)], np.uint16)
        self.letters[0] = 32
        # The first entry is the empty word, which has no ids.
        self.names, self.ids, self.size, self.again = pa.array([""]), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, bool)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words stand in the table; new ones are added."""
        if len(self.names) > self.limit:
            self._turn()
        at = pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy(zero_copy_only=False).copy()
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        spaced = np.ones(len(new), bool) if self.drops_space else pc.starts_with(words.take(pa.array(new)), " ").to_numpy(zero_copy_only=False)
        for some, spaced in ((new[spaced], True), (new[~spaced], False)):
            if len(some):
                names = words.take(pa.array(some))
                ids, size = self._learn(names, spaced)
                at[some] = len(self.names) + np.arange(len(some))
                self.names, self.ids, self.size = pa.concat_arrays([self.names, names]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return at

    def _learn(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Encode words in lines of 500; their ids are told apart by word ends, by the space that each begins with, or by a line feed after each."""
        cuts = pa.array([*range(0, len(words), 500), len(words)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(cuts, words), "\0" if spaced else "\0\n\0")
        ids = []
        for k in range(0, len(lines), 20):
            # Byte by byte as the vocabulary writes them.
            some = [self.letters[np.frombuffer(x.as_buffer(), np.uint8)].tobytes().decode("utf-16-le") for x in lines[k : k + 20]]
            some = some if spaced else [f"{x} {chr(self.letters[10])}" for x in some]
            ids += [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(some, add_special_tokens=False)]
        flat = np.concatenate(ids)
        if not spaced:
            last = flat == self.feed
            size = np.diff(np.flatnonzero(last), prepend=-1) - 1
            flat = flat[~last]
        elif self.drops_space:
            size = np.diff(np.flatnonzero(self.border[flat]), prepend=-1)
        else:
            size = np.diff(np.flatnonzero(self.border[flat]), append=len(flat))
        if len(size) != len(words) or size.sum() != len(flat):
            raise ValueError("the ids of a line of words can't be told apart")
        return flat, size

    def _turn(self) -> None:
        kept = np.flatnonzero(self.again)
        kept = np.concatenate([[0], kept[kept > 0][-(self.limit // 2) :]])
        self.ids = _runs(self.ids, (np.cumsum(self.size) - self.size)[kept], self.size[kept])
        self.names, self.size, self.again = self.names.take(pa.array(kept)), self.size[kept], np.zeros(len(kept), bool)


class PieceEncoder:
    """Encodes texts part by part.

    ``drops_space`` is for lower-casing vocabularies whose pre-tokenizer removes white space. About ``memo_limit`` words
    and a quarter as many other pieces are kept, whatever the corpus holds.
    """

    def __init__(self, path: str, drops_space: bool = False, memo_limit: int = 300_000, segment: int = 1 << 20):
        self.memo, self.drops_space, self.memo_limit, self.segment = _Pieces(path, drops_space), drops_space, memo_limit, segment
        self.words = _Words(self.memo, memo_limit)

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut between a word and the white space after it."""
        start = 0
        while len(text) - start > self.segment and (m := _BORDER.search(text, start + self.segment)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def _room(self) -> None:
        if len(self.memo) > self.memo_limit // 4:
            self.memo.clear()

    def _slowly(self, text: str) -> bytes:
        """Ids of any text."""
        out = []
        for part in self._segments(text):
            self._room()
            if re.search(_SEPARATORS, part):
                out.append(self.memo.whole(part))
            else:
                out.append(b"".join(map(self.memo.__getitem__, part.split() if self.drops_space else _SPACED.findall(part))))
        return b"".join(out)

    def _ids(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without a space inside, in a row, and how many each has."""
        found = pc.extract_regex(keys, _WORDS)
        other = pc.or_(found.is_null(), pc.greater(pc.utf8_length(keys), 64))
        first, marks, second, more = (pc.if_else(other, "", x) for x in found.flatten())
        words = pa.concat_arrays([first, second])
        words = (pc.utf8_lower(words) if self.drops_space else words).dictionary_encode()
        feed = pc.if_else(pc.or_(pc.equal(second, ""), self.drops_space), "", "\n")
        signs = pa.concat_arrays([marks, feed, more]).dictionary_encode()
        other = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        held = [self.memo[x] for x in [*signs.dictionary.to_pylist(), *keys.take(pa.array(other)).to_pylist()]]
        # Columns: first word, marks, line feed, second word, marks; a part of another form stands in the first.
        at, n = np.zeros((len(keys), 5), np.int64), len(keys)
        places = self.words.places(words.dictionary)
        known = len(self.words.names)
        at[:, 0::3] = places[words.indices.to_numpy()].reshape(2, n).T
        at[:, [1, 2, 4]] = known + signs.indices.to_numpy().reshape(3, n).T
        at[other, 0] = known + len(signs.dictionary) + np.arange(len(other))
        size = np.concatenate([self.words.size, np.fromiter(map(len, held), np.int64, len(held)) // 4])
        flat = np.concatenate([self.words.ids, np.frombuffer(b"".join(held), np.uint32)])
        each = size[at]
        return _runs(flat, (np.cumsum(size) - size)[at.ravel()], each.ravel()), each.sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (with the end of the last)."""
        self._room()
        pa.default_memory_pool().release_unused()  # Arrow holds on to what the batches before took
        plain = pc.invert(pc.or_(pc.match_substring_regex(texts, _SEPARATORS), pc.greater(pc.binary_length(texts), self.segment))).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(plain, texts, pa.scalar("", texts.type)), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        parts = split.flatten().dictionary_encode()
        at, keys = parts.indices.to_numpy().astype(np.int64), parts.dictionary.cast(pa.string())
        if not self.drops_space:
            # Single spaces cut the text where neither side is empty or ends in white space.
            odd = pc.or_(pc.equal(keys, ""), pc.not_equal(keys, pc.utf8_trim_whitespace(keys))).to_numpy(zero_copy_only=False)
            plain = plain & ~(np.add.reduceat(odd[at], bounds[:-1]) > 0) if len(at) else plain
            # A text's first word has no space before it.
            first, of = np.unique(at[bounds[:-1]], return_inverse=True)
            at[bounds[:-1]] = len(keys) + of
            keys = pa.concat_arrays([pc.binary_join_element_wise("", keys, " "), keys.take(pa.array(first))])
        flat, size = self._ids(keys)
        slow = np.flatnonzero(~plain).tolist()
        for k, i in enumerate(slow):
            at[bounds[i] : bounds[i + 1]] = len(size)  # all of its parts hold nothing but the first, which holds the text
            at[bounds[i]] = len(size) + 1 + k
        ids = [np.frombuffer(self._slowly(texts[i].as_py()), np.uint32) for i in slow]
        flat, size = np.concatenate([flat, *ids]), np.concatenate([size, [0], np.array([len(x) for x in ids], np.int64)])
        n = size[at]
        return _runs(flat, (np.cumsum(size) - size)[at], n), np.concatenate([[0], np.cumsum(n)])[bounds]


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, drops_space: bool = False) -> PieceEncoder:
    """One encoder for each Python worker."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, drops_space)
    return _ENCODERS[key]
