"""Token ids of whole texts with a public tokenizer file, memoised by piece of text.

A tokenizer that splits before merging gives a text's pieces between white space
ids that don't depend on what surrounds them. So a text is cut before each run of
blanks and line ends, every distinct piece goes through the library once, and the
text's ids are those of its pieces in a row. Texts with other white space or
separators (about which libraries disagree) go through the library whole, and so do
texts that hold a token the file adds to the model's, such as ``<|endoftext|>``: the
library finds those in the text before anything else, also inside words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .workers import give_back, remembered

PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
UNCLEAR_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")

#: A line end or blank, letters that are one letter however a text is normalised and lower-cased, and marks
#: other than the apostrophe (which may begin a token with letters after it).
PLAIN_WORD = re.compile(r"(\n?)((?<!\n) ?[A-Za-zÀ-ÖØ-öø-ÿ]+|(?<=\n)[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write bytes that print as themselves and the others as letters from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
PLAIN = re.compile(r" ?[^ \n]+")
#: Tried in this order; the first serves byte-level vocabularies, the second those that drop white space.
SEPARATORS = ("\n", " \ue000 ")

#: Pieces remembered by one worker (some 200 bytes each); longer pieces are not remembered.
REMEMBERED = 1_600_000
LONGEST = 48
#: Pieces of whole columns of texts that are remembered in arrays instead (some 40 bytes each).
KNOWN = 800_000
YOUNG = 100_000  #: beyond so many, pieces move there
LOOKED_UP = 16  #: arrays of so many times the pieces asked for take longer to look through than the library
MARKS = 10_000  #: different runs of marks remembered
CUT_BYTES = 8 << 20  #: texts are cut together up to so many bytes; a longer one alone


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    With ``plain`` the strings of added tokens are ordinary text, else they get their own
    ids wherever they stand, as by the library's default.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else self._added()
        self.size = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize  # each look at .model makes an object
        self.raw = [i.to_bytes(4, "little") for i in range(self.size)]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known = Known()
        self.marks: dict[str, bytes] = {"": b""}
        self.separator, self.separator_ids = self._separator()
        self.word_form = self._word_form()
        self.line_end = self._ids(["\n"])[0]

    def _added(self) -> list[str]:
        """Strings of which one is in every text that holds an added token; the empty one if that is unclear."""
        added = self.tokenizer.get_added_tokens_decoder().values()
        return sorted("" if t.normalized else t.content for t in added)

    def _word_form(self):
        """How a plain word reaches the tokenizer's model, if one of the known ways is this file's."""
        for form in (lambda w: w, lambda w: w.strip().lower()):
            words = [" Hello", "hello", " Été", "ñandú", " straße", " WORD"]
            end, mark = self._ids(["\n", "!.)"])
            cut = [f"\n{words[1]}!.)", f"{words[0]}!.)"]
            whole = [end + self._ids([words[1]])[0] + mark, self._ids([words[0]])[0] + mark]
            if [self._model_ids(form(w)) for w in words] == self._ids(words) and whole == self._ids(cut):
                return form
        return None

    def _model_ids(self, word: str) -> bytes:
        if word.isascii():  # letters and at most a leading blank
            mapped = word.replace(" ", BYTE_LETTERS[32])
        else:
            mapped = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(mapped)])

    def _separator(self) -> tuple[str, np.ndarray]:
        """A string that can stand between two pieces and always has ids of its own."""
        for text in SEPARATORS:
            own, a, b, spaced, with_a, with_spaced = self._ids(
                [text, "a", "b", " a", f"a{text}b", f" a{text} a"]
            )
            if own and with_a == a + own + b and with_spaced == spaced + own + spaced:
                return text, np.frombuffer(own, "<u4")
        return "", np.zeros(0, "<u4")

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; plain words in one call, as a call costs more than a word."""
        mark = self.separator.strip() or "\n"
        plain = [p for p in pieces if mark not in p and PLAIN.fullmatch(p)] if len(self.separator_ids) else []
        found: dict[str, bytes] = {}
        if len(plain) > 1:
            text = self.separator.join(plain)
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            wide = len(self.separator_ids)
            at = np.flatnonzero(ids[: len(ids) - wide + 1] == self.separator_ids[0])
            for k in range(1, wide):
                at = at[ids[at + k] == self.separator_ids[k]]
            if len(at) == len(plain) - 1:
                begin, end = [0, *(at + wide).tolist()], [*at.tolist(), len(ids)]
                raw = ids.tobytes()
                found = {p: raw[4 * a : 4 * b] for p, a, b in zip(plain, begin, end, strict=True)}
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._ids(rest) if rest else [], strict=True))
        return [found[p] for p in pieces]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _plain_word(self, match: re.Match) -> bytes:
        """Its line end, its word and its marks are tokens apart."""
        line_end, word, marks = match.groups()
        ids = self.memo.get(word) if line_end or marks else None
        if ids is None:
            ids = self._model_ids(self.word_form(word))
        if marks:
            after = self.marks.get(marks)
            if after is None:
                after = self._ids([marks])[0]
                if len(self.marks) < MARKS and len(marks) <= LONGEST:
                    self.marks[marks] = after
            ids += after
        return self.line_end + ids if line_end else ids

    def _new(self, new: Iterable[str]) -> dict[str, bytes]:
        """Ids of pieces not in use; short ones are remembered."""
        found: dict[str, bytes] = {}
        others, older, plain = [], self.older, PLAIN_WORD.fullmatch if self.word_form else lambda p: None
        for p in new:
            ids = older.get(p)
            if ids is None:
                match = plain(p)
                if match is None:
                    others.append(p)
                    continue
                ids = self._plain_word(match)
            found[p] = ids
        if others:
            found.update(zip(others, self._pieces(others), strict=True))
        if max(map(len, found), default=0) > LONGEST:
            self.memo.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        else:
            self.memo.update(found)
        return found

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as it were cut from a text by :data:`PIECE`."""
        if len(self.memo) > REMEMBERED // 2:  # what was not used for two generations is forgotten
            self.older, self.memo = self.memo, {}
        ids = list(map(self.memo.get, pieces))
        if None in ids:
            found = self._new({p for p, known in zip(pieces, ids, strict=True) if known is None})
            ids = [found[p] if known is None else known for p, known in zip(pieces, ids, strict=True)]
        return ids

    def is_whole(self, text: str) -> bool:
        """Whether the text must go through the library in one piece."""
        return UNCLEAR_SPACE.search(text) is not None or any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.is_whole(text):
            return self._ids([text])[0]
        return b"".join(self.of_pieces(PIECE.findall(text)))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, NULL as the empty one; a piece that many texts hold is looked up once."""
        for part in _stretches(texts.cast(pa.large_string()).fill_null("")):
            whole = [self.is_whole(t) for t in part.to_pylist()]
            cut = iter(self._together(part.filter(pa.array([not w for w in whole], pa.bool_()))))
            give_back()
            for text, alone in zip(part, whole, strict=True):
                yield self._ids([text.as_py()])[0] if alone else next(cut)

    def _together(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Ids of texts that go through the library piece by piece."""
        if not len(texts):
            return []
        pieces, first = pieces_of(texts)
        coded = pieces.dictionary_encode()
        found = self._of_distinct(coded.dictionary).take(coded.indices)
        edges = np.frombuffer(found.buffers()[1], np.int64)[found.offset :][first].tolist()
        ids = found.buffers()[2].to_pybytes() if edges[-1] else b""
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _of_distinct(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each piece; only those not known become objects of Python."""
        found = self.known.of(pieces)
        unknown = found.is_null()
        new = self.of_pieces(pieces.filter(unknown).to_pylist())
        if len(self.memo) > YOUNG:
            self.known.add(self.memo)
            self.memo = {}
        return pc.replace_with_mask(found, unknown, pa.array(new, pa.large_binary()))


class Known:
    """Pieces and their ids, without an object for each.

    When they are more than :data:`KNOWN`, those that were not used since that was last so are forgotten.
    """

    def __init__(self):
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used = np.zeros(0, bool)
        self.passed_over = False  #: some were asked for and not looked up

    def of(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each piece, NULL where it is not known, or too many others are."""
        if len(pieces) * LOOKED_UP < len(self.pieces):
            self.passed_over = True
            return pa.nulls(len(pieces), pa.large_binary())
        return self.ids.take(self._places(pieces))

    def add(self, found: dict[str, bytes]) -> None:
        pieces, ids = pa.array(found.keys(), pa.large_string()), pa.array(found.values(), pa.large_binary())
        if self.passed_over:
            new = self._places(pieces).is_null()
            pieces, ids, self.passed_over = pieces.filter(new), ids.filter(new), False
        if len(self.pieces) + len(pieces) > KNOWN:
            kept = pa.array(np.flatnonzero(self.used)[-(KNOWN // 2) :])
            self.pieces, self.ids, self.used = self.pieces.take(kept), self.ids.take(kept), np.zeros(len(kept), bool)
        self.pieces, self.ids = pa.concat_arrays([self.pieces, pieces]), pa.concat_arrays([self.ids, ids])
        self.used = np.append(self.used, np.zeros(len(pieces), bool))

    def _places(self, pieces: pa.LargeStringArray) -> pa.Int32Array:
        at = pc.index_in(pieces, value_set=self.pieces)
        self.used[at.drop_null().to_numpy()] = True
        return at


def _stretches(texts: pa.LargeStringArray) -> Iterator[pa.LargeStringArray]:
    """The texts in a row, those together that have not more than :data:`CUT_BYTES`."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + CUT_BYTES, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def pieces_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All texts' pieces in a row, cut as by :data:`PIECE`, and the place of each text's first one, and of the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    blank = (data == 32) | (data == 10)  # no byte of a longer character is one of these
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]  # a run of blanks begins a piece
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins[: offsets[0]] = False
    starts = np.flatnonzero(begins)
    edges = pa.py_buffer(np.append(starts, offsets[-1]))
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, edges, texts.buffers()[2]])
    return pieces, np.searchsorted(starts, offsets)


@remembered(maxsize=2)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One per worker process, file and meaning of added tokens."""
    return Encoder(path, plain)


def public_path(name: str) -> str:
    """Where the installed package of public vocabularies has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
