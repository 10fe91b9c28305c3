"""Token ids and counts with tables of the words met so far; each worker keeps its own."""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np

#: Entries of a table, of 0.2 KB each; a full table starts again.
MOST = 700_000
#: Latin text without apostrophes, of several chunks in lower case with "\n" between them, as the file's pattern cuts it.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+|\n")
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: These letters as byte-level vocabularies write their bytes in UTF-8.
_LETTERS = str.maketrans({chr(c): "".join(chr(b + (162 if b < 0xA1 else 0)) if b != 0xAD else chr(323) for b in chr(c).encode()) for c in range(0xDF, 0x100)})


class WordEncoder:
    """Ids of a `tokenizers` file whose normaliser folds white space and whose words stand alone.

    Texts are cut at ASCII white space, which no token spans. Chunks of plain Latin characters
    without apostrophes are cut further, as the file's own pattern does; others are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()
        self.pieces: dict[str, bytes] = {"\n": b""}

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.flat, self.start, self.length = bytearray(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _pieces(self, chunks: list[str]) -> list[bytes]:
        """The ids of plain chunks. Each piece is a word to the file's model, whose pattern and normaliser then have nothing to do."""
        if len(self.pieces) > MOST:
            self.pieces = {"\n": b""}
        known, cuts = self.pieces, _PIECES.findall("\n".join([*chunks, ""]).lower())
        new = [p for p in set(cuts) if p not in known]
        ids = [[t.id for t in self.model.tokenize(p if p.isascii() else p.translate(_LETTERS))] for p in new]
        to = np.cumsum([0, *map(len, ids)]) * 4
        raw, to = np.array(list(chain.from_iterable(ids)), np.uint32).tobytes(), to.tolist()
        known.update(zip(new, (raw[a:b] for a, b in zip(to, to[1:]))))
        got = [known[p] for p in cuts]
        length = np.array(list(map(len, got)), np.int64)
        to, raw = length.cumsum()[length == 0].tolist(), b"".join(got)
        return [raw[a:b] for a, b in zip([0, *to], to)]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = b"\n".join(chunks).decode("utf-8", "replace").split("\n")
        plain = np.array([c is not None for c in map(_PLAIN.fullmatch, texts)]) & ~np.array(["<|" in s for s in texts])
        got = self._pieces([texts[i] for i in np.flatnonzero(plain).tolist()])
        if len(got) < len(texts):
            odd = iter(got)
            got = [next(odd) if p else self._ids(s) for p, s in zip(plain.tolist(), texts)]
        length = np.array(list(map(len, got)), np.int64) // 4
        self.words.update(zip(chunks, range(len(self.length), len(self.length) + len(chunks))))
        self.start = np.concatenate((self.start, len(self.flat) // 4 + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat += b"".join(got)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        if len(self.words) > MOST:
            self.clear()
        # the file's normaliser lowers all letters after composing them; lowering A to Z first is the
        # same where nothing composes with them and no special token could come of it
        chunks = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        flat = [w for c in chunks for w in c]
        found = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        at = np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64)
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lost = np.flatnonzero(found < 0).tolist()
        if lost:
            self._learn(list({flat[i] for i in lost}))
            found[lost] = [self.words[flat[i]] for i in lost]
        length = self.length[found]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat(self.start[found] - ends[:-1], length) + np.arange(ends[-1])
        return np.frombuffer(bytes(self.flat), np.uint32)[place], ends[at]


class PieceCounter:
    """Counts of a `sentencepiece` file. No piece has a space sign after another character, so
    a text of words with single spaces between them counts as the sum of its words; any other
    text is encoded whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.alone = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.model.encode("a")) == 1 and self.model.encode(" a")[0] != self.model.encode("a")[0]
        self.words: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.words) > MOST:
            self.words = {}
        out, cuts, odd = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.alone and "  " not in t and "▁" not in t and "\0" not in t and t[0] != " " and t[-1] != " ":
                cuts.append((i, t.split(" ")))
            else:
                odd.append(i)
        new = list({w for _, c in cuts for w in c if w not in self.words})
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            self.words.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        get = self.words.__getitem__
        for i, c in cuts:
            out[i] = sum(map(get, c))
        for i in odd:
            out[i] = len(self.model.encode(texts[i], num_threads=1))
        return out


_MADE: dict[tuple[str, str], object] = {}


def forget() -> None:
    """Drops this worker's tables; the next encoder starts with empty ones."""
    _MADE.clear()


def encoder(kind: type, path: str):
    """One for each worker process and file."""
    if (kind.__name__, path) not in _MADE:
        _MADE[kind.__name__, path] = kind(path)
    return _MADE[kind.__name__, path]
