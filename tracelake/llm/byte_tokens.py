"""Texts to ids of a byte-level BPE by the tokenizers library, looking each distinct piece up once."""

from __future__ import annotations

import os

import numpy as np

from .token_store import distinct
from .windows import SPACE

#: First bytes of characters after which a space is surely followed by no white space: printable ASCII, and lead bytes that begin no Unicode space.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
CACHE = 500_000


class ByteEncoder:
    """Texts (bytes and offsets) to ids, as the tokenizer gives them for each whole text without special tokens added.

    The tokenizer first cuts a text by a pattern and never joins over a cut. It always cuts before a space that something solid
    follows, on both sides of a line feed that something solid follows, before a line feed that follows something solid, and between an
    ASCII letter and ASCII punctuation. So a text is cut there, each distinct piece of some MB is looked up once, and pieces used again are
    remembered, up to about twice CACHE. Texts with the string of a special token go through as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # How a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        """Remembers new pieces. One that is a word of letters, with a space before it or none, goes straight to the tokenizer's model."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain, words, rest = [], [], []
        for piece, text in zip(pieces, texts, strict=True):
            word = text[1:] if text[0] == " " else text
            (rest if not word.isalpha() else plain if word.isascii() else words if max(word) < "\u0530" else rest).append(piece)
        tokenize, four, feed = self.model.tokenize, self.four, self.alphabet[0x0A]
        lines = b"\n".join(plain).decode().replace(" ", self.alphabet[0x20]).split("\n") if plain else []
        lines += b"\n".join(words).decode("latin-1").translate(self.alphabet).split(feed) if words else []
        self.known.update((word, b"".join([four[t.id] for t in tokenize(line)])) for word, line in zip(plain + words, lines, strict=True))
        self.known.update(zip(rest, self.whole([p.decode("utf-8", "replace") for p in rest]), strict=True))

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        new = [p for p in pieces if p not in self.known]
        old = [p for p in new if p in self.before]
        self.known.update((p, self.before[p]) for p in old)
        if len(old) < len(new):
            self.learn([p for p in new if p not in self.known])
        return [self.known[p] for p in pieces]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``end``, and how many each text has."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        special = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                special.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, max(at + 1, int(offsets[max(special)])))
        cut = cuts(data, offsets)
        if special:  # these rows stay whole
            row = np.searchsorted(offsets, cut, "right") - 1
            cut = cut[~np.isin(row, list(special)) | np.isin(cut, offsets)]
        start, stop = cut, np.append(cut[1:], len(data))
        if not len(start):
            return np.full(rows, end, np.uint32), np.ones(rows, np.int64)
        first, kind = distinct(data, start, stop)
        found = self.ids_of([raw[a:z] for a, z in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
        found.append(np.array([end], "<u4").tobytes())
        after = np.searchsorted(start, offsets[1:])
        kind = np.insert(kind, after, len(found) - 1)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = size[kind]
        upto = np.cumsum(n)
        shift = (np.cumsum(size) - size)[kind] - upto + n
        out = np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, n) + np.arange(int(upto[-1]))]
        return out, np.diff(upto[after + np.arange(rows)], prepend=0)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin."""
    n = len(data)
    new = np.zeros(n, bool)
    if n > 1:
        left, right = data[:-1], data[1:]
        within = np.ones(n - 1, bool)  # both bytes are of one row
        inner = offsets[1:-1]
        within[inner[(inner > 0) & (inner < n)] - 1] = False
        solid, feed = SOLID[data], data == 0x0A
        before = within & solid[1:]
        alone = feed[:-1] & before  # a line feed before something solid is a piece, whatever white space stands before it
        new[:-1] |= (left == 0x20) & before | alone
        new[1:] |= alone | feed[1:] & solid[:-1] & (left < 0x80) | LETTER[left] & MARK[right]
    new[offsets[offsets < n]] = True
    return np.flatnonzero(new)


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
