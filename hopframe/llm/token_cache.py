"""Exact tokenization of whole texts, each distinct word piece of a stretch of texts encoded once.

A text is cut only where no token of the vocabulary's pre-tokenizer can cross. The pieces of some megabytes of texts
are dictionary-encoded, each distinct one is encoded by the tokenizers library, and the ids of a text are its pieces'
ids joined by array indexing. So results equal encoding the whole text, repeated words cost an array index, and nothing
is held beyond those megabytes.
"""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text, about, whose pieces are encoded together, and whose ids are put together.
BATCH_CHARS, PART_CHARS = 10 << 20, 4 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS_ONLY = re.compile(f"[{_LETTERS}]+")
#: After a letter and before one of these marks every pre-tokenizer in use ends a token.
_LETTER_MARK = re.compile(f"(?<=[{_LETTERS}])(?=[.,;:!?%*#$&|])")
#: Those of the marks that mostly end words; words that the model takes at a time.
_MARKS, JOINED = ".,", 8
#: Byte-level vocabularies write a byte that is no printable character as one from 256 on, in the bytes' order.
_HIDDEN_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(_HIDDEN_BYTES)}
_BYTE_TABLE = "".join(_BYTE_CHARS.get(b, chr(b)) for b in range(256))
#: A token in which a space follows a letter, or what may be the end of one.
_CROSSES = re.compile(f"[A-Za-z]Ġ|(?:^|Ã)[{_BYTE_TABLE[0x80:0xC0]}]Ġ")
_ASCII_SPACES = re.compile(r"[ \t\n\r]+")


def _byte_chars(text: str) -> str:
    """A text as byte-level vocabularies write it; a space becomes Ġ."""
    return codecs.charmap_decode(text.encode(), "strict", _BYTE_TABLE)[0]


class CachedTokenizer:
    """Encodes texts to unsigned 32-bit ids.

    word_spaces: the pre-tokenizer drops white space and never crosses it. Otherwise white space belongs to tokens,
    and a text is cut before a single space between characters that are not white space, and around a single line end
    between such characters.
    """

    def __init__(self, path: str, word_spaces: bool):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.word_spaces = word_spaces
        vocabulary = self.tokenizer.get_vocab()
        # where no token crosses the mark of a space, some words at a time have the same tokens as each by itself
        self.joined = not word_spaces and not any(map(_CROSSES.search, vocabulary))
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[k for t, k in vocabulary.items() if t[0] == "Ġ"]] = True

    def _letters(self, words: list[str], bare: bool):
        """ids, sizes of words of letters only: one token before the merges, so the model can take them."""
        import numpy as np

        tokenize = self.tokenizer.model.tokenize
        if self.joined and not bare:
            parts = [_byte_chars(" " + " ".join(words[k : k + JOINED])) for k in range(0, len(words), JOINED)]
            ids = np.array([t.id for p in parts for t in tokenize(p)], "<u4")
            return ids, np.diff(np.append(np.flatnonzero(self.starts[ids]), len(ids)))
        all_ = _byte_chars(" ".join(words).lower() if self.word_spaces else " ".join(words))
        tokens = list(map(tokenize, all_.split("Ġ") if bare or self.word_spaces else ["Ġ" + w for w in all_.split("Ġ")]))
        return np.array([t.id for ts in tokens for t in ts], "<u4"), np.array(list(map(len, tokens)), np.int64)

    def _plain(self, words: list[str], bare: bool):
        """ids, sizes of words, encoded by the library's whole chain."""
        import numpy as np

        found = [e.ids for e in self.tokenizer.encode_batch_fast(words if bare or self.word_spaces else [" " + w for w in words], add_special_tokens=False)]
        return np.array([x for ids in found for x in ids], "<u4"), np.array(list(map(len, found)), np.int64)

    def _words(self, words: list[str], bare: bool):
        """ids, starts, sizes: those of each of some words, all after a space or all bare."""
        import numpy as np

        start, size, flat, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.empty(0, "<u4")], 0
        plain = np.fromiter((w.isalpha() and (w.isascii() or _LETTERS_ONLY.fullmatch(w) is not None) for w in words), bool, len(words))
        parts = {k: _LETTER_MARK.split(words[k]) for k in np.flatnonzero(~plain).tolist()}
        whole = [k for k, p in parts.items() if len(p) == 1]
        for some, encode in ((np.flatnonzero(plain).tolist(), self._letters), (whole, self._plain)):
            if some:
                ids, size[some] = encode([words[k] for k in some], bare)
                start[some] = n + np.cumsum(size[some]) - size[some]
                flat.append(ids)
                n += len(ids)
        cut = {k: p for k, p in parts.items() if len(p) > 1}
        if cut:  # only the first part can follow a space; what follows a mark is bare
            blobs = []
            for flag, some in ((bare, {p[0] for p in cut.values()}), (True, {x for p in cut.values() for x in p[1:]})):
                own = list(some)
                ids, at, long_ = self._words(own, flag)
                data = ids.tobytes()
                blobs.append({w: data[4 * a : 4 * (a + b)] for w, a, b in zip(own, at.tolist(), long_.tolist(), strict=True)})
            for k, p in cut.items():
                blob = blobs[0][p[0]] + b"".join([blobs[1][x] for x in p[1:]])
                start[k], size[k] = n, len(blob) // 4
                flat.append(np.frombuffer(blob, "<u4"))
                n += len(blob) // 4
        return np.concatenate(flat), start, size

    def _safe(self, text: str) -> bool:
        """Whether spaces and line ends part a text: all its white space is of these two and, where it counts, single."""
        plain = text.replace("\n", " ")
        return plain.isprintable() and (self.word_spaces or ("  " not in plain and plain[:1] != " " != plain[-1:]))

    def _whole(self, text: str):
        """The ids of a text with other white space."""
        import numpy as np

        if self.word_spaces:
            pieces = [w for w in _ASCII_SPACES.split(text) if w]
            bare = [True] * len(pieces)
        else:
            pieces, bare = [], []
            for k, w in enumerate(text.split(" ")):
                # a space is a cut only between two characters that are not white space
                if k and not (w and not w[0].isspace() and pieces[-1] and not pieces[-1][-1].isspace()):
                    pieces[-1] += " " + w
                else:
                    pieces.append(w)
                    bare.append(not k)
        found = {}
        for flag in (False, True):
            own = list({p for p, b in zip(pieces, bare, strict=True) if b == flag})
            ids, at, size = self._words(own, flag)
            found[flag] = {w: ids[a : a + b] for w, a, b in zip(own, at.tolist(), size.tolist(), strict=True)}
        return np.concatenate([np.empty(0, "<u4"), *(found[b][p] for p, b in zip(pieces, bare, strict=True))])

    def _encode(self, texts: list[str], end: int | None):
        import numpy as np

        odd = {k: self._whole(t) for k, t in enumerate(texts) if not self._safe(t)}
        lines = pa.array([t if k not in odd else "" for k, t in enumerate(texts)], pa.large_string())
        lines = pc.replace_substring(lines, "\n", " " if self.word_spaces else " \n ")
        for mark in _MARKS:  # a mark that ends a word is a piece of its own, told by the sign before it
            lines = pc.replace_substring(lines, f"{mark} ", f" \x01{mark} ")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        del lines
        # no word holds a space, and one string is split faster than an array is read
        words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        code, at = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy() - split.offsets[0].as_py()
        del split, coded
        n = len(words)
        marks = [k for k, w in enumerate(words) if w[:1] == "\x01"]
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        for k in marks:
            words[k] = words[k][1:]
        bare = np.ones(len(code), bool) if self.word_spaces else is_mark[code]
        bare[at[:-1]] = True
        if not self.word_spaces and "\n" in words:
            is_line = code == words.index("\n")
            bare |= is_line
            bare[1:] |= is_line[:-1]
        # codes: words after a space, bare words, then what follows
        tables, known = [], 2 * n

        def add(own: list[str], flag: bool):
            nonlocal known
            tables.append(self._words(own, flag))
            known += len(own)
            return known - len(own)

        # a mark that follows no letter belongs to the piece before it
        ends = np.fromiter((_LETTERS_ONLY.fullmatch(w[-1:]) is not None for w in words), bool, n)
        loose = np.flatnonzero(is_mark[code[1:]] & ~ends[code[:-1]]) + 1
        code += n * bare
        if len(loose):
            heads: dict[int, list[int]] = {}
            head = last = -2
            for k in loose.tolist():
                head, last = (head if k == last + 1 else k - 1), k
                heads.setdefault(head, []).append(k)
            new = {}
            for flag in (False, True):
                own = [k for k in heads if bool(bare[k]) == flag]
                joined = ["".join([words[c % n] for c in code[[k, *heads[k]]].tolist()]) for k in own]
                place = {p: j for j, p in enumerate(dict.fromkeys(joined))}
                first = add(list(place), flag)
                new |= {k: first + place[p] for k, p in zip(own, joined, strict=True)}
            code[loose] = add([""], True)
            code[list(new)] = list(new.values())
        used = np.bincount(code[code < 2 * n], minlength=2 * n) > 0
        start, size = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        flat, held = [], 0
        for flag, base in ((False, 0), (True, n)):
            own = np.flatnonzero(used[base : base + n])
            ids, s, size[base + own] = self._words([words[k] for k in own.tolist()], flag)
            start[base + own] = s + held
            flat.append(ids)
            held += len(ids)
        starts, sizes = [start], [size]
        for ids, s, z in [*tables, *((x, np.zeros(1, np.int64), np.array([len(x)])) for x in odd.values()), (np.array([end or 0], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64))]:
            flat.append(ids)
            starts.append(s + held)
            sizes.append(z)
            held += len(ids)
        flat, start, size = np.concatenate(flat), np.concatenate(starts), np.concatenate(sizes)
        if odd:  # such a text is one empty piece
            code[at[list(odd)]] = known + np.arange(len(odd))
        if end is not None:
            code = np.insert(code, at[1:], len(start) - 1)
            at = at + np.arange(len(at))
        # ids of a part of the texts at a time
        long_ = np.cumsum([len(t) for t in texts]) // PART_CHARS
        for s, e in zip(*(lambda x: (x[:-1], x[1:]))([0, *(np.flatnonzero(np.diff(long_)) + 1).tolist(), len(texts)]), strict=True):
            part = code[at[s] : at[e]]
            counts = size[part]
            stop = np.concatenate([[0], np.cumsum(counts)])
            yield s, flat[np.repeat(start[part] - stop[:-1], counts) + np.arange(stop[-1])], stop[at[s : e + 1] - at[s]]

    def encode(self, column: pa.Array, end: int | None = None):
        """For some rows of a column of texts at a time: the first row, all their ids, where each row's ids begin.

        One more offset closes the last row. Null and empty texts have no ids; end is added to every text's.
        """
        part: list[str] = []
        size, first = 0, 0
        for k in range(len(column)):
            text = column[k].as_py() or ""
            part.append(text)
            size += len(text)
            if size >= BATCH_CHARS or k + 1 == len(column):
                for s, ids, offsets in self._encode(part, end):
                    yield first + s, ids, offsets
                part, size, first = [], 0, k + 1


_open: dict[tuple[str, bool], CachedTokenizer] = {}


def tokenizer(path: str, word_spaces: bool) -> CachedTokenizer:
    """This worker process's tokenizer for a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, word_spaces) not in _open:
        _open[path, word_spaces] = CachedTokenizer(path, word_spaces)
    return _open[path, word_spaces]
