"""Packs tokenised documents into training sequences of several lengths.

Each partition works through its own documents. Whole windows of the longest tier are cut off a long
document; what is left is routed to the smallest tier that holds it. A window of a tier is opened by a
piece of that tier, and the gap is filled from the shorter tiers, largest fitting piece first; the last
gap is closed by cutting a piece. Tiers are powers of two, so nothing but the very last window of a
partition can stay open. Sequences are dealt to step groups so that each group gets its share of every
tier.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame

from catalogmap.llm.rows import map_rows

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait in a partition before windows are closed.
POOL_PIECES = 4096
#: Entries of the cache of words per Python worker.
CACHE_WORDS = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Encode = Callable[[str], bytes]


#: White space other than the space and the line feed, where a word and the space before it need not be one pre-token.
RARE_SPACES = "".join(map(chr, (9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_bpe_encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[], Encode]:
    """Makes an encoder of a byte-level BPE: text → its ids as little-endian unsigned 32-bit values.

    ``added`` tokens are looked for in the text first, the leftmost and then the longest one; what lies between them is
    encoded piece by piece. A single space between two characters that are not white space always begins a new
    pre-token, so a piece is cut there, and the parts come from a cache.
    """

    def make() -> Encode:
        import array

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        names = sorted(added or {}, key=len, reverse=True)
        marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

        def packed(text: str) -> bytes:
            return array.array("I", encode(text)).tobytes()

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = packed(chunk)
                if len(chunk) <= 64:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[chunk] = ids
                return ids

        chunks = Chunks()

        def piece(text: str) -> bytes:
            plain = not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACES))
            first, *rest = text.split(" ") if plain else _CUT.split(text)
            return chunks[first] + b"".join(map(chunks.__getitem__, [" " + r for r in rest]))

        def run(text: str) -> bytes:
            if marks is None or not any(name in text for name in names):
                return piece(text)
            parts = marks.split(text)  # pieces and added tokens by turns
            return b"".join(added[t].to_bytes(4, "little") if i % 2 else piece(t) for i, t in enumerate(parts))

        return run

    return make


_ENCODERS: dict[tuple, Encode] = {}


class Packer:
    """The windows of one partition. A piece is (length, number, doc, start); the ids stay with the doc."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_tokens: int) -> None:
        self.tiers, self.next_id, self.step_tokens = tiers, first_id, step_tokens
        self.pool: list[tuple[int, int, tuple, int]] = []
        self.count = 0
        self.group = 0

    def add(self, doc: tuple, n: int) -> None:
        """doc is (doc_id, ids, tokens); its tokens enter the pool as whole windows and one rest."""
        longest = self.tiers[-1]
        for start in range(0, n, longest):
            self._put(min(longest, n - start), doc, start)

    def _put(self, length: int, doc: tuple, start: int) -> None:
        insort(self.pool, (length, self.count, doc, start))
        self.count += 1

    def _take(self, most: int, least: int = 1) -> tuple | None:
        """The largest piece of at most ``most`` tokens, if it has at least ``least``."""
        at = bisect_right(self.pool, (most, 1 << 62))
        if at and self.pool[at - 1][0] >= least:
            return self.pool.pop(at - 1)
        return None

    def _cut(self, room: int) -> tuple | None:
        """The first ``room`` tokens of the shortest longer piece; the rest goes back."""
        at = bisect_left(self.pool, (room + 1, -1))
        if at == len(self.pool):
            return None
        length, _, doc, start = self.pool.pop(at)
        self._put(length - room, doc, start + room)
        return room, 0, doc, start

    def close_windows(self, last: bool = False) -> Iterator[tuple]:
        """Rows of the windows that can be filled; at the end also of the one that cannot."""
        windows: list[tuple[int, list[tuple]]] = []
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while (opener := self._take(tier, below + 1)) is not None:
                parts, room = [opener], tier - opener[0]
                while room:
                    piece = self._take(room) or self._cut(room)
                    if piece is None:
                        break
                    parts.append(piece)
                    room -= piece[0]
                if room and not last:  # too little is left for a whole window: it waits
                    for length, _, doc, start in parts:
                        self._put(length, doc, start)
                    break
                windows.append((tier, parts))
        yield from self._dealt(windows)

    def _dealt(self, windows: list[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        tokens = sum(p[0] for _, parts in windows for p in parts)
        groups = max(1, round(tokens / self.step_tokens)) if windows else 0
        of_tier: dict[int, int] = {}
        for tier, _ in windows:
            of_tier[tier] = of_tier.get(tier, 0) + 1
        seen: dict[int, int] = {}
        for tier, parts in windows:
            k = seen[tier] = seen.get(tier, -1) + 1
            step, at = self.group + k * groups // of_tier[tier], 0
            for length, _, (doc_id, ids, n), start in parts:
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                yield doc_id, start, length, crc, n, self.next_id, at, tier, step
                at += length
            self.next_id += 1
        self.group += groups


def pack(docs: DataFrame, encoder: Callable[[], Encode], end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536) -> DataFrame:
    """One row per piece of a document: ``docs`` (columns doc_id, text) packed into windows.

    doc_id, start, length, ids_crc32 (unsigned, of the little-endian 32-bit ids), doc_tokens (with the end
    id), sequence_id, offset, tier (the window's length) and step_group. Every id lies in exactly one
    piece; offsets of a sequence leave no gap from 0. A null or empty text is the end id alone. A
    document without doc_id is packed with a null doc_id; repeated rows are packed each. A window takes
    its pieces from one partition only, so sequence ids (partition number and counter) depend on how
    ``docs`` is split, contents of documents do not. Other columns are not looked at.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    end = end_id.to_bytes(4, "little")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = (encoder.__qualname__, *(repr(c.cell_contents) for c in encoder.__closure__ or ()))
        if key not in _ENCODERS:  # one cache of words for all tasks of a worker
            _ENCODERS[key] = encoder()
        encode = _ENCODERS[key]
        part = TaskContext.get().partitionId()
        packer = Packer(tiers, part << 32, step_tokens)
        packer.group = part << 32
        waiting = 0
        for doc_id, text in rows:
            ids = encode(text or "") + end
            n = len(ids) // 4
            packer.add((doc_id, ids, n), n)
            waiting += n
            if len(packer.pool) >= POOL_PIECES or waiting >= POOL_PIECES * tiers[-1]:
                yield from packer.close_windows()
                waiting = 0
        yield from packer.close_windows(last=True)

    return map_rows(docs.select("doc_id", "text"), run, PIECES)
