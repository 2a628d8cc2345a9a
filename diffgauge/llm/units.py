"""Public tokenizers applied unit by unit.

A unit is a stretch of text that the tokenizer's own splitter can never join with its neighbours, so the
ids of a text are the ids of its units in a row. Natural text repeats its units, hence each Python worker
keeps the ids of the units it has met and runs the tokenizer on new ones only. The result is the same as
encoding whole texts; a test holds both against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

CACHED_UNITS = 1_000_000      # per Python worker; a dictionary of this size has not grown its table once more
LONGEST_CACHED = 64         # characters
TEXTS_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 22      # texts whose units are looked up together
UNITS_AT_ONCE = 256

_PLAIN = re.compile(r" ?\S+")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _settled(c: str) -> bool:
    """A letter since Unicode 3.2, alone in its composed form, whose small letter is one as well."""
    low = c.lower()
    return (unicodedata.ucd_3_2_0.category(c)[0] == "L" and c.isalpha() and len(low) == 1 and low.isalpha()
            and unicodedata.is_normalized("NFC", c + low) and c != "Σ" and not "\u1100" <= c <= "\u11ff")


_GAP = "\x00"       # no letter
_CONTROLS = [chr(c) for c in range(32) if not chr(c).isspace()]
_PRIVATE = [chr(c) for c in range(0xe000, 0xf900)]


def _ranges(letters: Iterable[str]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in map(ord, letters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


# words that any splitter takes whole and any library lowers and composes alike
_LETTERS = " ?[%s]+" % _ranges(filter(_settled, map(chr, range(0x41, 0x10000))))
_WORD = re.compile(_LETTERS)
_MARKED = rf"\A(?P<word>{_LETTERS})(?P<marks>[.,;:!?%#$&*|]+)\z"


def free_cut(texts: list[str]) -> str:
    """A control character that no text holds, else two different private ones that no text holds in a row."""
    cuts = chain(_CONTROLS, map("".join, permutations(_PRIVATE, 2)))
    return next(c for c in cuts if not any(c in t for t in texts))


def dropped_spaces(text: str, cut: str) -> str:
    """Units of a lower-casing tokenizer that drops white space; A-Z are lowered here, so fewer units differ."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return text.replace("\n", cut).replace(" ", cut)


def leading_spaces(text: str, cut: str) -> str:
    """Units of a byte-level tokenizer, whose words carry the one space before them."""
    # other white space and control characters are not printable
    if not text.replace("\n", "").isprintable() or any(two in text for two in ("  ", " \n", "\n ", "\n\n")):
        return _BEFORE_SPACE.sub(cut, text)
    return text.replace("\n", f"{cut}\n{cut}").replace(" ", f"{cut} ")


Cuts = tuple[np.ndarray, np.ndarray, np.ndarray]     # ids, and where those of each unit begin and end


class UnitEncoder:
    """``units`` gives a text with a cut between its units, which no text at hand holds.

    ``between`` is white space that keeps units apart when many new ones are encoded in one call.

    A text that holds the string of one of the tokenizer's special tokens is encoded whole, as the library does.
    """

    def __init__(self, path: str, units: Callable[[str, str], str]):
        self.path, self.library = path, None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True     # lowered units may look like a special token that the text lacks
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units, self.between = units, "\n"
        # the id of white space between units, where the tokenizer gives it one
        ids = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        # words need no splitter: their letters stand for bytes, and no merge reaches over the gap between two
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = self.spelling = ByteLevel(add_prefix_space=False, use_regex=False)
        [(self.gap, _)] = self.spelling.pre_tokenize_str(_GAP)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.gap_id = vocab.get(self.gap) if not any(self.gap in t and t != self.gap for t in vocab) else None
        self.in_rows = self.gap_id is not None and not self.tokenizer.normalizer and not self.tokenizer.model.end_of_word_suffix
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and stop - at < TEXTS_AT_ONCE and size + len(texts[stop]) <= CHARS_AT_ONCE:
                size += len(texts[stop])
                stop += 1
            out += self._encode(texts[at:stop])
            at = stop
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        cut = free_cut(texts)
        lists = pc.split_pattern(pa.array(["" if i in whole else self.units(t, cut) for i, t in enumerate(texts)],
                                          pa.large_string()), cut)
        # each different unit of these texts is looked up once
        coded = lists.flatten().dictionary_encode()
        # marks behind letters are a unit of their own: no splitter joins the two, so one word is encoded once
        parts = pc.extract_regex(coded.dictionary, _MARKED)
        word = pc.coalesce(pc.struct_field(parts, "word"), coded.dictionary)
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "")
        joined = pc.binary_join_element_wise(self._look_up(word), self._look_up(marks), pa.scalar(b"", pa.large_binary()))
        joined = joined.take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        if whole and self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return [self._ids(self.library, t) if i in whole else bytes(ids[ends[i]:ends[i + 1]])
                for i, t in enumerate(texts)]

    def _look_up(self, units: pa.Array) -> pa.Array:
        coded = units.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, own))
        new = [u for u, ids in zip(own, found) if ids is None]
        if new:
            if len(self.known) + len(new) > CACHED_UNITS:
                self.known.clear()
            fresh = self._learn(new)
            found = [fresh[u] if ids is None else ids for u, ids in zip(own, found)]
            self.known.update((u, ids) for u, ids in fresh.items() if len(u) <= LONGEST_CACHED)
        return pa.array(found, pa.large_binary()).take(coded.indices)

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Words by the tokenizer's model, other plain units (no space inside) in joint calls, the rest alone."""
        fresh, words, plain = {}, [], []
        for u in new:
            if len(u) > LONGEST_CACHED:
                fresh[u] = self._ids(self.tokenizer, u)
            elif _WORD.fullmatch(u):
                words.append(u)
            elif _PLAIN.fullmatch(u):
                plain.append(u)
            else:
                fresh[u] = self._ids(self.tokenizer, u)
        for some, learn in ((words, self._row if self.in_rows else self._words), (plain, self._joint)):
            for at in range(0, len(some), UNITS_AT_ONCE):
                own = some[at:at + UNITS_AT_ONCE]
                ids, left, right = learn(own)
                fresh.update(zip(own, map(ids.tobytes().__getitem__, map(slice, (4 * left).tolist(), (4 * right).tolist()))))
        return fresh

    def _row(self, own: list[str]) -> Cuts:
        """Words in one row, a gap before each."""
        [row] = self.letters.encode_batch_fast([_GAP + _GAP.join(own)], add_special_tokens=False)
        ids = np.asarray(row.ids, "<u4")
        gaps = np.flatnonzero(ids == self.gap_id)
        return ids, gaps + 1, np.append(gaps[1:], len(ids))

    def _words(self, own: list[str]) -> Cuts:
        """Words one by one, as the model gets them from the splitter: normalized, spelled in bytes, without spaces."""
        text = _GAP.join(own).replace(" ", "")
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        [(text, _)] = self.spelling.pre_tokenize_str(text)
        tokens = list(map(self.tokenizer.model.tokenize, text.split(self.gap)))
        ids = np.fromiter((t.id for own in tokens for t in own), "<u4")
        ends = np.cumsum([0, *map(len, tokens)])
        return ids, ends[:-1], ends[1:]

    def _joint(self, own: list[str]) -> Cuts:
        text, ids, marks = self.between + self.between.join(own), None, ()
        if self.mark is not None:       # where marks part the units no offsets are asked for
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
        if len(marks) == len(own):
            left = marks + 1
            right = np.append(marks[1:], len(ids))
        else:       # cut by offsets
            joint = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.asarray(joint.ids, "<u4")
            begins = np.fromiter((o[0] for o in joint.offsets), np.int64, len(ids))
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            first = np.cumsum(lengths + 1) - lengths        # where each unit begins in the joint text
            left = np.searchsorted(begins, first)
            right = np.searchsorted(begins, first + lengths)
        return ids, left, right


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, units: Callable[[str, str], str]) -> UnitEncoder:
    """The encoder of this Python worker."""
    key = (path, units.__name__)
    if key not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = UnitEncoder(path, units)
    return _ENCODERS[key]
