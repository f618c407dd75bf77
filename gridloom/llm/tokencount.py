"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its initial symbols minus the merges made, plus the extra bytes of characters that the
vocabulary lacks. No identifier is ever looked up. Merges are popped from a heap by rank, then by place; neighbours
are a doubly linked list of symbol starts, so a word of n symbols costs O(n log n) however long it is.

A text is cut only where no piece of the vocabulary can cross: before a run of word-start marks that follows
another character, and around characters that occur in no longer piece. This is checked when the vocabulary loads.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, file_broadcast, map_rows

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback and identity normalisation does."""

    def __init__(self, model: str | bytes, most_cached: int = 300_000):
        """model: the path of a vocabulary, or its bytes."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(**{"model_file" if isinstance(model, str) else "model_proto": model})
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        merging = {c for p in self.rank if len(p) > 1 for c in p}
        solo = "".join(c for c in "\n\r\t" if c not in merging)
        lone = f"|[{re.escape(solo)}]+" if solo else ""
        self.cut = re.compile(f"{MARK}*[^{MARK}{re.escape(solo)}]+|{MARK}+{lone}").findall if self.cuttable else (lambda s: [s])
        self.memo = Memo(self.count_piece, most_cached)

    def count_piece(self, s: str) -> int:
        """Tokens of a stretch that no piece crosses."""
        n, rank = len(s), self.rank
        if s in rank and n == 1:
            return 1
        get = rank.get
        pair = [get(s[i : i + 2], -1) for i in range(n - 1)]
        heap = [(r << 32) | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return sum(1 if c in rank else len(c.encode()) for c in s)
        heapq.heapify(heap)
        pair.append(-1)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            key = pop(heap)
            left = key & 0xFFFFFFFF
            if pair[left] != key >> 32:
                continue  # one side has been merged since
            merges += 1
            right = after[left]
            pair[right] = -1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                r = pair[left] = get(s[left : after[follow]], -1)
                if r >= 0:
                    push(heap, (r << 32) | left)
            else:
                pair[left] = -1
            prior = before[left]
            if prior >= 0:
                r = pair[prior] = get(s[prior:follow], -1)
                if r >= 0:
                    push(heap, (r << 32) | prior)
        count, i = n - merges, 0
        if any(c not in rank for c in s):
            while i < n:
                if after[i] == i + 1 and s[i] not in rank:
                    count += len(s[i].encode()) - 1
                i = after[i]
        return count

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        memo = self.memo
        return sum([memo[w] for w in self.cut(MARK + text.replace(" ", MARK))])


@lru_cache(maxsize=2)
def loaded(file: bytes) -> PieceCounter:
    """A worker's counter and cache, for all of its tasks."""
    return PieceCounter(file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every text.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows each get their row; an empty
    table gives no rows; other columns are ignored. Each row is counted on its own, whatever its length, so there is no
    shuffle.
    """
    file = file_broadcast(docs.sparkSession, model_file)

    def start() -> Callable[..., tuple]:
        count = loaded(file.value)

        def one(key, text):
            n = count(text)
            return key, len(text.encode()) if text else 0, n, n > limit

        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], SCHEMA, start)
