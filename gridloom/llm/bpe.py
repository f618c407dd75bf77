"""BPE encoding and decoding with a contiguous rank array for each word.

A word's parts and the ranks of its adjacent parts lie in two short arrays. The smallest rank is found by scanning, its
boundary is deleted, and the ranks of the two neighbouring pairs are refreshed, until none can merge. The new words of
a batch do so together, one word to a row of two matrices, and rows that are done leave. Words longer than LONG symbols
find the minimum through a heap instead, so a run of a million letters isn't quadratic.

What a letter, a digit or a blank is, how characters compose and what their lower case is, depends on the version of
Unicode. Beyond ASCII the vocabulary file's own normaliser and pre-tokenizer decide, as the tokenizers library runs them;
merging and decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, file_broadcast, map_rows

#: Symbols of the longest word that is merged by scanning.
LONG = 64
#: Rows of the matrices at most.
ROWS = 4096
NONE = np.int64(1 << 40)
#: Stretches that the library normalises together.
TOGETHER = 500
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBPE:
    """A tokenizers BPE file with word ends: NFC, white space collapsed, lower case, split by pattern, byte letters."""

    def __init__(self, file: str | bytes, most_cached: int = 400_000):
        """file: the path of a vocabulary, or its bytes."""
        import tokenizers

        if isinstance(file, str):
            with open(file, "rb") as f:
                file = f.read()
        spec = json.loads(file)
        library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {}
        for k, m in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(m if isinstance(m, list) else m.split(" ")), k)
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.added).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # In lowered ASCII the classes are plain ranges.
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r\x20"), re.ASCII).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.letters = byte_letters()
        self.byte_of = {ord(c): b for b, c in enumerate(self.letters)}
        self.memo = Memo(self.chunk, most_cached)
        self.load_pairs()

    def load_pairs(self) -> None:
        """Pairs of ids as sorted keys, with the rank of each and the id that it merges to."""
        known = [(self.vocab[a] << 20 | self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.ranks.items() if {a, b, a + b} <= self.vocab.keys()]
        # One row for a key: a pair of other letters that spell the same ids can't be, since ids name letters.
        table = np.array(sorted(known), np.int64).reshape(-1, 3)
        self.keys, self.key_rank = np.append(table[:, 0], 1 << 62), np.append(table[:, 1], NONE)
        self.merged = np.full(len(self.ranks) + 1, -1, np.int64)
        self.merged[table[:, 1]] = table[:, 2]
        self.inner = np.array([self.vocab.get(c, -1) for c in self.letters], np.int64)
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in self.letters], np.int64)
        self.regular = len(known) == len(self.ranks) and (self.inner >= 0).all() and (self.last >= 0).all()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where there is none or one side is past the end (-1)."""
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """The ids of short words, all merged together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        cols = np.arange(width)
        letters = np.frombuffer(b"".join(words), np.uint8)
        parts = np.full((len(words), width), -1, np.int64)
        parts[cols < sizes[:, None]] = self.inner[letters]
        parts[np.arange(len(words)), sizes - 1] = self.last[letters[np.cumsum(sizes) - 1]]
        rows, out = np.arange(len(words)), [[]] * len(words)
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.full((len(words), 1), NONE)
        while True:
            low = ranks.argmin(axis=1)
            going = ranks[np.arange(len(rows)), low] < NONE
            for r, ids in zip(rows[~going].tolist(), parts[~going].tolist(), strict=True):
                out[r] = ids[: ids.index(-1)] if ids[-1] < 0 else ids
            if not going.any():
                return out
            rows, low, parts, ranks = rows[going], low[going], parts[going], ranks[going]
            n, at = np.arange(len(rows)), low[:, None]
            new = self.merged[ranks[n, low]]
            # Delete the boundary: what lies right of it moves one to the left.
            wide = np.concatenate([parts, np.full((len(rows), 1), -1)], axis=1)
            parts = np.where(cols > at, wide[:, 1:], parts)
            parts[n, low] = new
            more = np.concatenate([ranks, np.full((len(rows), 1), NONE)], axis=1)
            ranks = np.where(np.arange(ranks.shape[1]) >= at, more[:, 1:], ranks)
            # Refresh the two neighbours.
            right = np.where(low + 1 < width, parts[n, np.minimum(low + 1, width - 1)], -1)
            ranks[n, np.minimum(low, ranks.shape[1] - 1)] = self.pair_ranks(new, right)
            has = low > 0
            ranks[n[has], low[has] - 1] = self.pair_ranks(parts[n[has], low[has] - 1], new[has])

    def long_word(self, word: bytes) -> list[int]:
        parts = [self.letters[b] for b in word]
        parts[-1] += self.end
        vocab = self.vocab
        return [vocab[p] for p in self.merge_long(parts) if p in vocab]

    def words_ids(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """The ids of each pre-token, given as UTF-8."""
        short = sorted((w for w in words if len(w) <= LONG and self.regular), key=len)
        got = {w: self.long_word(w) for w in words if len(w) > LONG or not self.regular}
        for k in range(0, len(short), ROWS):
            part = short[k : k + ROWS]
            got |= zip(part, self.merge_rows(part), strict=True)
        return got

    def merge_long(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])] + [NONE]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            parts[i], parts[j], ranks[j] = parts[i] + parts[j], "", NONE
            k = after[i] = after[j]
            ranks[i] = NONE
            if k < n:
                before[k] = i
                ranks[i] = get((parts[i], parts[k]), NONE)
                if ranks[i] != NONE:
                    heapq.heappush(heap, (ranks[i], i))
            h = before[i]
            if h >= 0:
                ranks[h] = get((parts[h], parts[i]), NONE)
                if ranks[h] != NONE:
                    heapq.heappush(heap, (ranks[h], h))
        return [p for p in parts if p]

    def chunk(self, raw: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes, and decoded text, of a stretch without white space."""
        return self.chunk_all([raw])[raw]

    def pre_tokens(self, raws: list[str]) -> dict[str, list[bytes]]:
        """The words of each stretch as UTF-8, normalised. Stretches beyond ASCII go through the library together.

        They stand apart by blanks, across which nothing composes; one that itself holds a blank of another kind goes alone.
        """
        split, found, wide = self.split_ascii, {}, []
        for raw in raws:
            if raw.isascii():
                found[raw] = [w.encode() for w in split(raw.lower())]
            elif ODD_SPACE(raw):
                found[raw] = [w.translate(self.byte_of).encode("latin-1") for w, _ in self.pre_tokenize(self.normalize(raw))]
            else:
                wide.append(raw)
        for k in range(0, len(wide), TOGETHER):
            part = wide[k : k + TOGETHER]
            text = self.normalize(" ".join(part))
            words = iter(self.pre_tokenize(text))
            word, (begin, _) = next(words, ("", (len(text), 0)))
            end = 0
            for raw, own in zip(part, text.split(" "), strict=True):
                end += len(own) + 1
                mine = found[raw] = []
                while begin < end and word:
                    mine.append(word.translate(self.byte_of).encode("latin-1"))
                    word, (begin, _) = next(words, ("", (len(text), 0)))
        return found

    def parted(self, text: str) -> list[str]:
        """Stretches of text at even places, added tokens at odd ones."""
        return self.special(text) if self.special and any(t in text for t in self.added) else [text]

    def chunk_all(self, raws: list[str]) -> dict[str, tuple[bytes, str]]:
        split = self.pre_tokens(raws)
        ids_of = self.words_ids({w for words in split.values() for w in words})
        found = {}
        for raw, words in split.items():
            ids = ids_of[words[0]] if len(words) == 1 else [i for w in words for i in ids_of[w]]
            found[raw] = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)
        return found

    def prepare(self, texts: list[str | None]) -> None:
        """Puts what a batch's texts need into the cache, all new words at once."""
        memo, needed = self.memo, set()
        for text in texts:
            for part in self.parted(text or "")[::2]:
                needed.update(chunks(part))
        new = []
        for c in needed:
            if c not in memo and len(c) <= memo.longest:
                value = memo.old.get(c)
                if value is None:
                    new.append(c)
                else:
                    memo.put(c, value)  # so that it outlives the old generation
        for k in range(0, len(new), 4 * ROWS):
            for raw, value in self.chunk_all(new[k : k + 4 * ROWS]).items():
                memo.put(raw, value)

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        memo, parts = self.memo, self.parted(text)
        out = [memo[w] for w in chunks(parts[0])]
        for token, part in zip(parts[1::2], parts[2::2], strict=True):
            out.append((struct.pack("<I", self.added[token]), token))
            out += [memo[w] for w in chunks(part)]
        return out

    def encode(self, text: str | None) -> list[int]:
        data = b"".join([p[0] for p in self.pieces(text or "")])
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def decode(self, ids) -> str:
        """Without a decoder in the file, tokens stand joined by spaces; unknown ids are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        found = [p for p in self.pieces(text or "") if p[0]]
        data = b"".join([p[0] for p in found])
        decoded = " ".join([p[1] for p in found])
        return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


#: Characters that str.split() takes for blanks and that aren't ASCII blanks; what they are is left to the library.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
BY_BLANKS = re.compile(r"[^\t-\r\x20]+").findall


def chunks(text: str) -> list[str]:
    """Stretches without ASCII blanks; nothing that follows can join two of them."""
    return BY_BLANKS(text) if ODD_SPACE(text) else text.split()


@lru_cache(maxsize=2)
def loaded(file: bytes) -> WordBPE:
    """A worker's tokenizer and cache, for all of its tasks."""
    return WordBPE(file)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids and the decoded text of every text: the operator's own output, for writing token tables.

    Null and empty texts have no ids and decode to ''; a null id stays null; repeated rows each get their row; an empty
    table gives no rows; other columns are ignored.
    """
    file = file_broadcast(docs.sparkSession, tokenizer)

    def start() -> Callable[..., tuple]:
        bpe = loaded(file.value)

        def one(key, text):
            ids = bpe.encode(text)
            return key, ids, bpe.decode(ids)

        one.prepare = lambda keys, texts: bpe.prepare(texts)
        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], FULL_SCHEMA, start)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and SHA-256 of every text's ids, and SHA-256 of what they decode to. Cases as encoded(); no shuffle."""
    file = file_broadcast(docs.sparkSession, tokenizer)

    def start() -> Callable[..., tuple]:
        bpe = loaded(file.value)

        def one(key, text):
            return key, *bpe.digest(text)

        one.prepare = lambda keys, texts: bpe.prepare(texts)
        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], SCHEMA, start)
