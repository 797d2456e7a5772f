"""Ids of texts, remembered by chunk.

A vocabulary's splitter never joins across certain places, so the ids of a text are those of its chunks in order, and
chunks repeat far more often than texts do. Texts are cut into chunks a few megabytes at a time; equal chunks of such a
group are found by dictionary encoding, and ids are put together by array look-ups. What a worker remembers are flat
sorted arrays: 64-bit hashes of chunks, where their ids lie, and the ids, in two generations of bounded size, the
older of which is let go when the younger is full. Only chunks in neither reach the tokenizers library, many in one
string. Encoders are kept per worker process, so that tasks after the first start warm.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from docrisk.llm.common import mix

# White space as the byte-level splitter sees it, and how the splitter of the word vocabulary cuts a chunk.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LIMIT = 1_200_000  # chunks in each generation, about 25 bytes each
LONGEST = 64  # bytes of a chunk that is remembered
TOGETHER = 2_000  # new chunks in one call
GROUP = 1 << 22  # characters of text cut at once; longer texts are cut apart first, where a chunk ends


class Memory:
    """Ids by hash of a chunk: sorted keys, and where in the pool the ids lie."""

    def __init__(self, kind: np.dtype):
        self.keys, self.at, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted ``keys``, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def ids(self, place: np.ndarray) -> np.ndarray:
        """Ids at some places, one after another."""
        return gather(self.pool, self.at[place], self.size[place])

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Sorted new keys with their ids one after another."""
        where = np.searchsorted(self.keys, keys)
        at = len(self.pool) + np.cumsum(size, dtype=np.int32) - size
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.pool = np.concatenate([self.pool, ids])


def gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``pool`` one after another."""
    done = np.cumsum(size, dtype=np.int32)
    place = np.repeat(at - (done - size), size)
    place += np.arange(len(place), dtype=np.int32)
    return pool[place]


_MIX = np.random.default_rng(1).integers(0, 2**64, LONGEST + 1, np.uint64, endpoint=False) | np.uint64(1)


def hashes(values: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of strings of at most LONGEST bytes (others have 0), and lengths in bytes."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.empty(0, np.uint8)
    for n in np.unique(size[size <= LONGEST]).tolist():  # strings of one length form a matrix
        rows = np.flatnonzero(size == n)
        sums = np.full(len(rows), n + 1, np.uint64) * _MIX[LONGEST]
        for i in range(n):
            sums += (data[offsets[rows] + i].astype(np.uint64) + np.uint64(1)) * _MIX[i]
            sums ^= sums >> np.uint64(29)
        out[rows] = mix(sums)
    return out, size


class ChunkEncoder:
    """Maps texts to ids; a subclass says how texts are cut and how many chunks are encoded at once."""

    EDGE: re.Pattern  # where a chunk may end in a very long text

    def __init__(self, path: str, limit: int = LIMIT, group: int = GROUP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.group = Tokenizer.from_file(path), limit, group
        self.names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.kind = np.dtype("<u2" if max(self.names) < 1 << 16 else "<u4")
        self.young, self.old = Memory(self.kind), Memory(self.kind)

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Chunks of all texts, and where each text's chunks begin and end."""
        raise NotImplementedError

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, as if alone, and the ids of all."""
        raise NotImplementedError

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int32, len(found)), np.fromiter((i for ids in found for i in ids), self.kind)

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text, as unsigned integers of ``kind``."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > self.group:
                yield from self._group(held)
                held, size = [], 0
                yield np.concatenate([x for piece in self._pieces(text) for x in self._group([piece])])
                continue
            held.append(text)
            size += len(text)
            if size >= self.group:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.group and (edge := self.EDGE.search(text, at + self.group)):
            yield text[at : edge.start()]
            at = edge.start()
        yield text[at:]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        coded, ends = self.cut(pa.array(texts, pa.large_string()))
        at, size, pool = self._look_up(coded.dictionary)
        which = coded.indices.to_numpy()
        length = size[which]
        done = np.zeros(len(which) + 1, np.int32)  # a group's ids are few enough
        np.cumsum(length, out=done[1:])
        flat, cuts = gather(pool, at[which], length), done[ends].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _look_up(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of some distinct chunks lie, how many, and the ids."""
        keys, n_bytes = hashes(chunks)
        order = np.argsort(keys, kind="stable")
        keys, short = keys[order], n_bytes[order] <= LONGEST
        place, place_old = self.young.find(keys), self.old.find(keys)
        place[~short] = place_old[~short] = -1
        place_old[place >= 0] = -1
        new = np.flatnonzero((place < 0) & (place_old < 0))
        words = chunks.take(pa.array(order[new])).to_pylist()
        parts = [self.encode(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        size_new = np.concatenate([np.empty(0, np.int32), *[p[0] for p in parts]])
        ids_new = np.concatenate([np.empty(0, self.kind), *[p[1] for p in parts]])
        seen, again = place >= 0, place_old >= 0
        size = np.zeros(len(keys), np.int32)
        size[seen], size[again], size[new] = self.young.size[place[seen]], self.old.size[place_old[again]], size_new
        # The three kinds lie one after another in the pool of this group.
        ids_again = self.old.ids(place_old[again])
        pool = np.concatenate([self.young.ids(place[seen]), ids_again, ids_new])
        at, start = np.zeros(len(keys), np.int32), 0
        for kind in (seen, again, new):
            total = np.cumsum(size[kind], dtype=np.int32)
            at[kind] = start + total - size[kind]
            start += int(total[-1]) if len(total) else 0
        self._learn(keys, size, np.flatnonzero(again), ids_again)
        keep = short[new]
        self._learn(keys, size, new[keep], ids_new[np.repeat(keep, size_new)])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return at[back], size[back], pool

    def _learn(self, keys: np.ndarray, size: np.ndarray, which: np.ndarray, ids: np.ndarray) -> None:
        if len(self.young.keys) + len(which) > self.limit:
            self.old, self.young = self.young, Memory(self.kind)
        if 0 < len(which) <= self.limit:
            self.young.add(keys[which], size[which], ids)


class ByteEncoder(ChunkEncoder):
    """Byte-level vocabulary: white space belongs to what follows, so a chunk is white space and what follows it.

    Texts are cut before every space and line feed; where white space then stands at the end of a chunk, the cut was
    inside a longer run of it, and that text is cut again by a pattern.
    """

    EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
    CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    PLAIN = re.compile(f"[ \n][^{WHITE}]+")
    BLANKS = [c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]
    BLANK_LAST = re.compile(f"[{WHITE}]([{WHITE}]|\\Z)")  # a chunk of white space alone
    RE2 = re.sub("[^!-~ ]", lambda m: f"\\x{{{ord(m[0]):x}}}", WHITE)

    def __init__(self, path: str, limit: int = LIMIT, group: int = GROUP):
        super().__init__(path, limit, group)
        self.width = np.zeros(max(self.names) + 1, np.int64)  # a token's name has one character per byte
        self.width[list(self.names)] = [len(t) for t in self.names.values()]

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        split = pc.split_pattern(marked, "\0")
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        open_ = pc.match_substring_regex(coded.dictionary, f"[{self.RE2}]$").to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
        open_[ends[1:] - 1] = False  # white space at the end of a text is a chunk
        again = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        again[np.searchsorted(ends, np.flatnonzero(open_), side="right") - 1] = True
        if not again.any():
            return coded, ends
        chunks, parts, counts, start = split.flatten(), [], np.diff(ends), 0
        for i in np.flatnonzero(again).tolist():  # runs of texts cut right, and between them those cut anew
            own = self.CHUNK.findall(texts[i].as_py())
            parts += [chunks.slice(ends[start], ends[i] - ends[start]), pa.array(own, pa.large_string())]
            counts[i], start = len(own), i + 1
        parts.append(chunks.slice(ends[start], ends[-1] - ends[start]))
        return pa.concat_arrays(parts).dictionary_encode(), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with one space or line feed follow each other in one string, which is cut at their lengths in bytes."""
        joined = "".join(chunks)
        if not all(c[:1] in (" ", "\n") for c in chunks) or sum(map(joined.count, self.BLANKS)) != len(chunks) or self.BLANK_LAST.search(joined):
            first = [i for i, c in enumerate(chunks) if not self.PLAIN.fullmatch(c)]
            if len(first) == len(chunks):
                return self.each(chunks)
            odd = np.zeros(len(chunks), bool)
            odd[first] = True
            size, ids = np.zeros(len(chunks), np.int32), np.empty(0, self.kind)
            (size_odd, ids_odd), (size_plain, ids_plain) = self.each([chunks[i] for i in first]), self.encode([c for c, o in zip(chunks, odd) if not o])
            size[odd], size[~odd] = size_odd, size_plain
            ids = np.empty(size.sum(), self.kind)
            of_odd = np.repeat(odd, size)
            ids[of_odd], ids[~of_odd] = ids_odd, ids_plain
            return size, ids
        ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
        ends = np.cumsum(self.width[ids])
        want = np.cumsum([len(c) for c in chunks] if joined.isascii() else [len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        last = np.searchsorted(ends, want)
        if not len(ids) or last[-1] != len(ids) - 1 or (ends[last] != want).any():
            return self.each(chunks)
        return np.diff(last + 1, prepend=0).astype(np.int32), ids


class WordEncoder(ChunkEncoder):
    """Vocabulary with word ends, lower case, white space dropped: a chunk is a run of bytes that are not ASCII blanks.

    ASCII is lowered before the text is cut, but for texts that may hold special tokens, which are matched before the
    case is lowered.
    """

    EDGE = re.compile("[\t-\r ]")
    SPLIT = regex.compile(WORD_SPLIT)

    def __init__(self, path: str, limit: int = LIMIT, group: int = GROUP):
        super().__init__(path, limit, group)
        self.word_ends = np.zeros(max(self.names) + 1, bool)
        self.word_ends[[i for i, t in self.names.items() if t.endswith("</w>")]] = True

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        chunks, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)  # blanks at either end leave an empty one
        if not real.all():
            chunks, ends = chunks.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
        return chunks.dictionary_encode(), ends

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks in one string, cut at the ids that end a word; if that does not tally, each alone."""
        count = np.fromiter((len(self.SPLIT.findall(c)) for c in chunks), np.int64, len(chunks))
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.word_ends[ids]) + 1
        if len(ends) != count.sum() or not (count > 0).all():
            return self.each(chunks)
        return np.diff(ends[np.cumsum(count) - 1], prepend=0).astype(np.int32), ids


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(kind: type[ChunkEncoder], path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file."""
    key = (kind.__name__, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]
