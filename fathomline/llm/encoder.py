"""Token ids of many texts by the tokenizers library, each distinct piece of text encoded once.

Byte-level BPE never merges across the places where its pattern splits. `pieces` cuts texts at a subset of those places
(before a space that follows a visible character, after a line break or tab that stands alone, between an ASCII letter and punctuation;
the last of several white spaces goes with what follows, so no cut is after those),
so the ids of a text are those of its pieces, one after the other. The text of an added token gives that token's id. Pieces are known by a 64-bit hash of their bytes;
what a worker has encoded stays, up to `KEPT` pieces. New pieces go to the library many to a text, with an added token between them.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from fathomline.llm.text import IS_SPACE, U, span_hashes

KEPT = 1_000_000
#: New pieces of a text that goes to the library; of many more, its own cache of words is of less use.
JOINED = 64
#: Last bytes of characters that Unicode counts as white space; no cut follows them.
WIDE_SPACE_END = np.zeros(256, bool)
WIDE_SPACE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_encoders: dict[str, Encoder] = {}


def pieces(data: np.ndarray, at: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and the number of them in each text. No cut is inside the text of an added token."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    space = IS_SPACE[data]
    before, now = data[:-1], data[1:]
    cut = np.zeros(n, bool)
    alone = space[:-1] & (before != 32)
    alone[1:] &= ~space[:-2] & ~WIDE_SPACE_END[data[:-2]]
    cut[1:] = (space[1:] & ~space[:-1] & ~WIDE_SPACE_END[before]) | (alone & ~space[1:] & (now < 128)) | (LETTER[before] & PUNCTUATION[now])
    raw = data.tobytes() if added else b""
    for token in added:
        spot = raw.find(token)
        while spot >= 0:
            cut[spot + 1 : spot + len(token)] = False
            spot = raw.find(token, spot + 1)
    cut[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, at))


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder()
        self.added = tuple(t.content.encode() for t in tokens.values())
        #: An added token that takes nothing of what is beside it, or None; and the bytes that any added token begins or ends with.
        self.between = next(((i, t.content.encode()) for i, t in tokens.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.edges = b"".join(t[:1] + t[-1:] for t in self.added)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)  # sorted hashes
        self.entry = np.zeros(0, np.int64)  # of each, its place in the two below
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these pieces, how many each has, and the order of the pieces in both.

        The library cuts added tokens out before it looks at the rest, so pieces with one between them give the ids that they give alone. A piece with a byte that an added token
        begins or ends with might hold one or make one with its neighbour: it goes alone.
        """
        alone = np.array([self.between is None or len(t.translate(None, self.edges)) < len(t) for t in texts], bool)
        order = np.argsort(alone, kind="stable")
        joined = len(texts) - int(alone.sum())
        flat, size = [], []
        if joined:
            end, token = self.between
            own = [texts[i] for i in order[:joined]]
            last = np.array([end], np.uint32)
            ids = np.concatenate([v for e in self.encode([token.join(own[i : i + JOINED]) for i in range(0, joined, JOINED)]) for v in (e, last)])
            cut = np.flatnonzero(ids == end)
            flat.append(np.delete(ids, cut))
            size.append(np.diff(cut, prepend=-1) - 1)
        rest = self.encode([texts[i] for i in order[joined:]])
        return np.concatenate([*flat, *rest]), np.concatenate([*size, np.fromiter(map(len, rest), np.int64, len(rest))]), order

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        flat, size, order = self.encode_pieces(texts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        spot = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, spot, hashes)
        self.entry = np.insert(self.entry, spot, len(self.size) + place)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and how many each has."""
        start, counts = pieces(data, at, self.added)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        end = np.append(start[1:], len(data))
        hashes, where, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self.forget()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            whole = data.tobytes()
            self.learn(hashes[new], [whole[start[i] : end[i]] for i in where[new]])
            spot = np.searchsorted(self.known, hashes)
        each = self.entry[spot][back]
        size, begin = self.size[each], self.begin[each]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]
        first = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], ends])
        return ids, sums[first[1:]] - sums[first[:-1]]


def encoder(path: str) -> Encoder:
    """This worker's encoder of that vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each text; and where each then starts (one more entry: the end)."""
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
