"""Token ids of whole texts, many texts at a time.

A byte-level BPE encodes every pre-token on its own, and pre-tokens repeat. So a batch is cut into pre-tokens with array
operations over its UTF-8 bytes, the tokenizers library encodes each distinct one once (a bounded cache keeps those of
earlier batches), and the ids are gathered back. Texts that hold an added token's string, and vocabularies with another
pre-tokenizer, go through the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ticktide.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Ranges of code points outside of which there are no letters and numbers.
ASSIGNED = ((0, 0x33480), (0xE0000, 0xE1000))
#: Distinct pre-tokens that a worker remembers at most, about.
CACHE = 1_000_000

_classes: np.ndarray | None = None
_coders: dict[tuple[str, int], "BatchCoder"] = {}


def char_classes() -> np.ndarray:
    """Class of each code point, made once a process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.full(0x110000, OTHER, np.uint8)
        for first, end in ASSIGNED:
            table[first:end] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(first, end)), np.uint8, end - first)
        table[WHITE_SPACE] = BLANK
        _classes = table
    return _classes


def pretoken_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start. data: UTF-8 bytes of all texts; texts: where each text starts, and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = char_classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        at = lambda k: data[np.minimum(lead + k, n - 1)].astype(np.int64) & 0x3F
        two = (first & 0x1F) << 6 | at(1)
        three = (first & 0x0F) << 12 | at(1) << 6 | at(2)
        four = (first & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)
        point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
        kind[lead] = table[np.minimum(point, 0x10FFFF)]
        for k in (1, 2, 3):
            wide = lead[first >= (0xC0, 0xE0, 0xF0)[k - 1]]
            kind[wide + k] = kind[wide]
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[texts] = True
    start |= edge
    start[n] = True
    # a blank run before other text gives up its last character, which joins what follows if it is a space
    ends = np.flatnonzero(start[1:] & (kind == BLANK)) + 1
    ends = ends[~edge[ends]]
    last = ends - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[ends[data[last] == 0x20]] = False
    # 's 't 're 've 'm 'll 'd where an apostrophe starts a pre-token
    mark = np.flatnonzero((data == 0x27) & start[:n])
    if len(mark):
        after = lambda k: data[np.minimum(mark + k, n - 1)]
        inside = lambda k: (mark + k < n) & ~edge[np.minimum(mark + k, n)]
        short = inside(1) & np.isin(after(1), np.frombuffer(b"stmd", np.uint8))
        pair = after(1).astype(np.int64) << 8 | after(2)
        long = inside(1) & inside(2) & np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return np.flatnonzero(start[:n])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at starts and have counts members, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 31) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - ends + counts).astype(kind), counts)


#: Bytes that are hashed at once, but for a longer run, and places in a run whose values are looked up.
AT_ONCE, PLACES = 1 << 19, 64
_values: np.ndarray | None = None


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Runs are ascending and apart; inside says which bytes are in one, if not all are.
    A run's hash is the sum of one random number for each byte and its place, and the length, mixed."""
    global _values
    if _values is None:
        _values = common.mix(np.arange(PLACES * 256, dtype=np.uint64) + np.uint64(1))
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + AT_ONCE, side="right")))
        a, b = int(starts[first]), int(ends[last - 1])
        at = starts[first:last] - a
        place = np.arange(b - a) - np.repeat(at, np.diff(at, append=b - a))
        key = place << 8 | data[a:b]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            values = np.empty(b - a, np.uint64)
            near = place < PLACES
            values[near] = _values[key[near]]
            values[far] = common.mix(key[far].astype(np.uint64) + np.uint64(1))
        else:
            values = _values[key]
        if inside is not None:
            values *= inside[a:b]
        out[first:last] = np.add.reduceat(values, at)
        first = last
    return common.mix(out ^ (ends - starts).astype(np.uint64) << np.uint64(40))


def same_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of data the number of its string, for each such number where it first occurs, and a hash of each piece.

    Pieces are grouped by a hash and each is then compared with its group's first byte by byte.
    """
    import pandas as pd

    ends = np.append(starts[1:], len(data))
    hashes = run_hashes(data, starts, ends)
    code, _ = pd.factorize(hashes)
    first = np.empty(code.max() + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    held = starts[first[code]]
    counts = ends - starts
    if (counts != counts[first[code]]).any() or (data[ragged(held, counts)] != data).any():
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64).tobytes())
        found = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        code = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first, hashes


class Pieces:
    """Strings with their ids, found by a hash and compared byte by byte. Of strings that share a hash one can be found."""

    def __init__(self):
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and which piece each is of
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)  # batches that each piece was in

    def __len__(self) -> int:
        return len(self.met)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which piece each run of data is, -1 if none."""
        found = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return found
        asked = np.argsort(hashes)  # in order, a search stays near the last one's place
        at = np.minimum(np.searchsorted(self.hashes, hashes[asked]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[asked]
        found[asked[same]] = self.order[at[same]]
        likely = np.flatnonzero(found >= 0)
        likely = likely[np.diff(self.text_at)[found[likely]] == counts[likely]]
        sizes = counts[likely]
        other = data[ragged(starts[likely], sizes)] != self.text[ragged(self.text_at[found[likely]], sizes)]
        ok = np.add.reduceat(other, np.cumsum(sizes) - sizes) == 0 if len(likely) else np.zeros(0, bool)
        kept = np.full(len(hashes), -1, np.int64)
        kept[likely[ok]] = found[likely[ok]]
        return kept

    def add(self, hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Appends pieces: their bytes and ids, one piece's after the other's."""
        n = len(self)
        new, which = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, new)
        fresh = self.hashes[np.minimum(at, len(self.hashes) - 1)] != new if len(self.hashes) else np.ones(len(new), bool)
        self.hashes, self.order = np.insert(self.hashes, at[fresh], new[fresh]), np.insert(self.order, at[fresh], n + which[fresh])
        self.text, self.text_at = np.concatenate([self.text, text]), np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(sizes)])
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.met = np.append(self.met, np.zeros(len(sizes), np.int64))

    def only(self, keep: np.ndarray) -> Pieces:
        """The pieces of ascending numbers, each met once so far."""
        made, place = Pieces(), np.full(len(self), -1, np.int64)
        place[keep] = np.arange(len(keep))
        held = place[self.order] >= 0
        made.hashes, made.order = self.hashes[held], place[self.order][held]
        sizes, counts = np.diff(self.text_at)[keep], np.diff(self.at)[keep]
        made.text, made.text_at = self.text[ragged(self.text_at[keep], sizes)], np.append(0, np.cumsum(sizes))
        made.ids, made.at = self.ids[ragged(self.at[keep], counts)], np.append(0, np.cumsum(counts))
        made.met = np.ones(len(keep), np.int64)
        return made


class BatchCoder:
    """encode() gives the same ids as the library's encode() of each text, add_special_tokens=False."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        cut = said.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said.get("normalizer") and not said.get("post_processor")
        self.added = [x["content"] for x in said.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)  # bytes of each id: one character stands for a byte
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()

    def shrink(self) -> None:
        """Forgets pieces that one batch alone had, and of the others the rarer ones beyond half of the cache."""
        met = self.known.met
        keep = np.flatnonzero(met > 1)
        if len(keep) > self.cache // 2:
            keep = np.sort(keep[np.argsort(-met[keep], kind="stable")[: self.cache // 2]])
        self.known = self.known.only(keep)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Puts the ids of pre-tokens, distinct and new, into the cache and gives their numbers there. Space and letters: many in one
        text, cut where their bytes end."""
        names, sizes = pieces.to_numpy(zero_copy_only=False), pc.binary_length(pieces).to_numpy().astype(np.int64)
        letters = pc.match_substring_regex(pieces, r"^ \pL+$").to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(letters), [np.flatnonzero(~letters)]
        order, flat, counts = [], [], []
        for i in range(0, len(plain), 4000):
            some = plain[i : i + 4000]
            ids = np.array(self.whole(["".join(names[some].tolist())])[0], np.int64)
            ends = np.cumsum(sizes[some])
            made = np.cumsum(self.width[ids])
            stop = np.searchsorted(made, ends) + 1
            if made[-1] != ends[-1] or (made[stop - 1] != ends).any():  # can't be cut
                rest.append(some)
                continue
            order.append(some)
            flat.append(ids.astype(np.uint32))
            counts.append(np.diff(stop, prepend=0))
        others = np.concatenate(rest)
        one = self.whole(names[others].tolist())
        order.append(others)
        flat.append(np.array([i for x in one for i in x], np.uint32))
        counts.append(np.array([len(x) for x in one], np.int64))
        order, numbers = np.concatenate(order), np.empty(len(names), np.int64)
        numbers[order] = np.arange(len(self.known), len(self.known) + len(order))
        taken = pieces.take(pa.array(order))
        text = np.frombuffer(taken.buffers()[2], np.uint8)[: int(sizes.sum())]
        self.known.add(hashes[order], text, sizes[order], np.concatenate(flat), np.concatenate(counts))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and where each text's begin, with the end (int64). Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), bool)
        for added in self.added:
            odd |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        if not self.by_piece:
            odd[:] = True
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
        body = plain.buffers()[2] if len(plain) else None
        data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        starts = pretoken_starts(data, at)
        code, first, hashes = same_pieces(data, starts) if len(starts) else (np.zeros(0, np.int64),) * 3
        distinct, own = hashes[first], starts[first]
        sizes = np.append(starts, len(data))[first + 1] - own
        held = self.known.find(distinct, data, own, sizes)
        missing = np.flatnonzero(held < 0)
        if len(self.known) + len(missing) > self.cache and len(self.known):
            self.shrink()
            held = self.known.find(distinct, data, own, sizes)
            missing = np.flatnonzero(held < 0)
        if len(missing):
            bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64).tobytes())
            pieces = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).take(pa.array(first[missing]))
            held[missing] = self.learn(pieces, distinct[missing])
        known = self.known
        known.met[held] += 1
        own = known.at[held + 1] - known.at[held]  # ids of each distinct piece
        few = known.ids[ragged(known.at[held], own)]
        counts = own[code]
        ids = few[ragged((np.cumsum(own) - own)[code], counts)]
        per_piece = np.concatenate([[0], np.cumsum(counts)])
        ends = per_piece[np.searchsorted(starts, at)]
        if odd.any():
            where = np.flatnonzero(odd)
            own = dict(zip(where, self.whole(texts.take(pa.array(where)).to_pylist())))
            parts = [np.array(own[i], np.uint32) if i in own else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            ids = np.concatenate(parts) if parts else ids
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends


def coder(path: str, cache: int = CACHE) -> BatchCoder:
    """The process's coder for a vocabulary file."""
    if (path, cache) not in _coders:
        _coders[path, cache] = BatchCoder(path, cache)
    return _coders[path, cache]


def release() -> None:
    """Lets the process's coders go: workers outlive stages, and those that don't encode shouldn't hold them."""
    if _coders:
        _coders.clear()
        common.trim()


def slices(batch: pa.RecordBatch, *columns: str, size: int = 2 << 20):
    """Parts of a batch whose texts have about size bytes at most, a single longer text in a part of its own."""
    lengths = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(lengths, (lengths[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
