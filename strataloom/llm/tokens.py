"""Fast exact encoding with tokenizer files, for operators that need the ids of whole texts.

A text is cut before white space and between words and signs, where the pre-tokenizers of these files
always cut too, so the ids of a text are the ids of its parts in order. Parts repeat a lot:
they are told apart by two 64-bit hashes computed for a whole run of texts at once, and each distinct
part goes to the library once per worker for as long as the worker remembers it.
"""

from __future__ import annotations

import base64
import os
import threading

import numpy as np

from strataloom.llm import shared

#: A worker forgets all but the latest parts beyond this number; about 150 bytes each.
CACHE_PARTS = 700_000
#: New parts meet the library in runs of so many, each run one text with a mark after each part.
RUN = 1000
MARK = b"\x00"

_SECOND = 0xD1342543DE82EF95
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)
_SECOND_UP = shared._powers(_SECOND, shared._BLOCK)
_SECOND_DOWN = shared._powers(_SECOND_INVERSE, shared._BLOCK)
_made: dict = {}
_lock = threading.Lock()


def _classes() -> np.ndarray:
    """Of each byte: 1 white space, 2 letter or digit, 4 other ASCII sign, 8 apostrophe, 16 beyond ASCII, 32 control."""
    kinds = np.full(256, 16, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 if b in shared.SPACE_BYTES else 32 if b < 0x20 or b == 0x7F else 2 if c.isalnum() else 8 if c == "'" else 4
    return kinds


_KIND = _classes()


def safe_starts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where the pre-tokenizers always cut.

    Before white space that follows none; after a lone line feed; between a letter or digit and a sign, the
    apostrophe excepted. White space beyond ASCII has two bytes after C2 or three after E1, E2 or E3: next to
    characters that might be such, nothing is cut.
    """
    if len(data) < 4:
        return np.empty(0, dtype=np.int64)
    kind = _KIND[data]
    here, left = kind[1:], kind[:-1]
    signs = ((here == 4) & (left == 2)) | ((here == 2) & (left == 4))
    at = np.flatnonzero(signs | ((here == 1) & (left != 1)) | ((left == 1) & (here != 1) & (data[:-1] == 0x0A))) + 1
    edge = kind[at] + kind[at - 1] != 6  # else a sign between ASCII characters
    near = at[edge]
    get = lambda k: data[np.clip(near + k, 0, len(data) - 1)]
    wide = lambda lead: (lead >= 0xE1) & (lead <= 0xE3)
    odd = lambda lead, low: (lead == 0xC2) & ((low == 0x85) | (low == 0xA0))
    before = kind[near] == 1
    back = np.where(before, 0, 1)  # a cut after a line feed needs what stands before that line feed
    one, two, three = (data[np.clip(near - k - back, 0, len(data) - 1)] for k in (1, 2, 3))
    ok = (one > 0x20) & ~odd(two, one) & ~wide(three) & ~((near - 1 - back) < 0)
    ok &= before | ((get(0) > 0x20) & ~odd(get(0), get(1)) & ~wide(get(0)))
    keep = np.ones(len(at), dtype=bool)
    keep[np.flatnonzero(edge)] = ok
    return at[keep]


class PartEncoder:
    """Encodes with a file of the tokenizers library; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # a normalizer that lower-cases makes parts alike that differ in ASCII case
        self.fold = "Lowercase" in self.tokenizer.to_str()[:4000]
        self.mark = self.tokenizer.encode(" " + MARK.decode(), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.empty(0, dtype=self.kind)
        self.first = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)
        self.second = np.empty(0, dtype=np.uint64)

    def _keep(self, key: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Forgets all parts but those of the present texts, and returns the places of these."""
        old = found[found >= 0]
        ids = [self.pool[a : a + n] for a, n in zip(self.first[old].tolist(), self.size[old].tolist(), strict=True)]
        size, second = self.size[old], self.second[old]
        self._forget()
        self.pool = np.concatenate([self.pool, *ids])
        self.first, self.size, self.second = np.cumsum(size) - size, size, second
        out = np.full(len(key), -1, dtype=np.int64)
        out[found >= 0] = np.arange(len(old))
        self.known = dict(zip(key[found >= 0].tolist(), range(len(old)), strict=True))
        return out

    def _library(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part. Most go in runs: a part that begins with a blank and holds no mark meets
        only marks there, which are words of their own."""
        out: list = [None] * len(parts)
        fit = [i for i, p in enumerate(parts) if len(p) <= 200 and p[:1] == b" " and p[1:2].strip() and MARK not in p]
        for i in set(range(len(parts))).difference(fit):
            out[i] = np.array(self.tokenizer.encode(parts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self.kind)
        runs = [fit[i : i + RUN] for i in range(0, len(fit), RUN)]
        texts = [b"".join([parts[i] + b" " + MARK for i in run]).decode("utf-8", "replace") for run in runs]
        for run, coded in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype=self.kind)
            ends = np.flatnonzero(ids == self.mark[-1])
            if len(ends) != len(run):
                raise RuntimeError("a part holds the mark's id")
            starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
            for i, a, b in zip(run, starts, (ends - (len(self.mark) - 1)).tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by whole texts, for the rare run in which two parts share their first hash."""
        coded = self.tokenizer.encode_batch_fast([t.encode("utf-8", "replace").decode() for t in texts], add_special_tokens=False)
        ids = [np.array(c.ids, dtype=self.kind) for c in coded]
        return np.concatenate([np.empty(0, dtype=self.kind), *ids]), np.cumsum([0, *map(len, ids)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the place where each text's begin, and the end."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        joined = b"\n".join(raw) + b"\n"
        if self.fold:
            joined = joined.lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        offs = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=offs[1:])
        filled = np.flatnonzero(sizes)
        cuts = safe_starts(data)
        text = np.searchsorted(offs, cuts, side="right") - 1
        inside = (cuts != offs[text]) & (cuts != offs[text + 1] - 1)  # not the line feeds between texts
        if self.fold:  # a capital sigma's lower case depends on letters beyond signs
            inside &= ~np.array(["\u03a3" in t for t in texts])[text]
        starts = np.sort(np.concatenate((cuts[inside], offs[filled])))
        ends = np.append(starts[1:], 0)
        # the last part of each text ends before the line feed that follows the text
        at = np.searchsorted(starts, offs)
        ends[at[filled + 1] - 1] = offs[filled + 1] - 1
        if not len(starts):
            return np.empty(0, dtype=self.kind), np.zeros(len(raw) + 1, dtype=np.int64)
        span = (ends - starts).astype(np.uint64)
        wide = data.astype(np.uint64) + np.uint64(1)
        keys = []
        for up, down, base, inverse in ((shared._UP, shared._DOWN, shared._BASE, shared._INVERSE), (_SECOND_UP, _SECOND_DOWN, _SECOND, _SECOND_INVERSE)):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(wide * shared._spread(up, base, len(data)), out=sums[1:])
            keys.append((sums[ends] - sums[starts]) * shared._spread(down, inverse, len(data))[starts] + span)
        key, one, which = np.unique(keys[0], return_index=True, return_inverse=True)
        second = keys[1][one]
        if not np.array_equal(second[which], keys[1]):
            return self._whole(texts)
        found = np.array([self.known.get(k, -1) for k in key.tolist()], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.known) + len(new) > CACHE_PARTS:
                found = self._keep(key, found)
            ids = self._library([joined[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            found[new] = len(self.first) + np.arange(len(new))
            self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
            self.size, self.second = np.concatenate((self.size, size)), np.concatenate((self.second, second[new]))
            self.pool = np.concatenate([self.pool, *ids])
            self.known.update(zip(key[new].tolist(), found[new].tolist(), strict=True))
        if not np.array_equal(self.second[found], second):
            return self._whole(texts)
        first, size = self.first[found][which], self.size[found][which]
        ends_out = np.cumsum(size)
        total = int(ends_out[-1])
        out = self.pool[np.repeat(first - (ends_out - size), size) + np.arange(total)]
        return out, np.concatenate(([0], ends_out))[at]


def encoder(path: str) -> PartEncoder:
    """One for each worker and file."""
    with _lock:
        if path not in _made:
            _made[path] = PartEncoder(path)
        return _made[path]


def rank_file(path: str, pattern: str):
    """A tiktoken encoding without special tokens from a local rank file."""
    import tiktoken

    with _lock:
        if path not in _made:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
            _made[path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _made[path]
