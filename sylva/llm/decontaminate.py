"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are folded to lower-case words, joined by single spaces and set between spaces, so that
an occurrence of a folded window is an occurrence of its words. A shift table over hashes of blocks of
bytes says how far the search may jump; where the shift is 0, a bucket of the block's hash lists the windows
whose first bytes end in it, and they are compared directly. Windows are grouped by length, so that one short item does
not shorten the jumps of all.

Defined results: a null or empty text, and one without words, has no words and no hits. Items without words match nothing; the windows of an item with a null
id hit words, but it is not counted or listed; items with the same id count as one. With an empty item table no
document is hit, and an empty document table gives an empty result. Texts are searched whole at any length. Repeated rows are treated one by one alike. Other columns are ignored.

Items reach the executors in blocks of at most ``BLOCK_BYTES`` of text (one larger item is a block of its
own); each block is one pass over the documents, without a shuffle. Up to ``CHAIN`` passes run within one job; then the documents with
their hits so far are written to the shared folder, so that no task holds more tables than these.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import Scratch, map_arrow, pick, utf8

WINDOW = 13
BLOCK_BYTES = 256 << 10
CHAIN = 16
TABLE_BITS = 20
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def framed(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All windows of ``size`` words; of fewer words, but not none, the one window they make."""
    if not words:
        return []
    return [framed(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class _Group:
    """Wu-Manber tables for patterns of similar lengths."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.m = m = min(map(len, patterns))
        self.block = b = max(1, min(16, m // 2))
        self.far = m - b + 1
        self.mask = (1 << TABLE_BITS) - 1
        #: a jump of at most 255 bytes, which is safe for any longer one
        self.shift = bytearray([min(255, self.far)]) * (1 << TABLE_BITS)
        self.bucket: dict[int, list[bytes]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                h = hash(p[end - b : end]) & self.mask
                if m - end < self.shift[h]:
                    self.shift[h] = m - end
            self.bucket.setdefault(hash(p[m - b : m]) & self.mask, []).append(p)

    def occurrences(self, text: bytes):
        """Yields (start, pattern) of every occurrence."""
        shift, mask, b, m, bucket = self.shift, self.mask, self.block, self.m, self.bucket
        end, size = m, len(text)
        while end <= size:
            h = hash(text[end - b : end]) & mask
            jump = shift[h]
            if jump:
                end += jump
                continue
            for p in bucket.get(h, ()):
                if text.startswith(p, end - m):
                    yield end - m, p
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.owners: dict[bytes, set[str | None]] = {}
        for item, text in items:
            for p in windows_of(words_of(text), window):
                self.owners.setdefault(p, set()).add(item)
        classes: dict[int, list[bytes]] = {}
        for p in self.owners:
            classes.setdefault(len(p).bit_length(), []).append(p)
        self.groups = [_Group(ps) for ps in classes.values()]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges hit, and the items with a window in the text."""
        text = framed(words)
        found = [hit for g in self.groups for hit in g.occurrences(text)]
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = np.searchsorted(spaces, [at for at, _ in found])
        ranges = sorted({(int(k), int(k) + p.count(b" ") - 1) for k, (_, p) in zip(first, found)})
        return ranges, set().union(*(self.owners[p] for _, p in found)) - {None}


_cached: tuple[int, Matcher] | None = None


def _matcher(items: list[tuple[str, bytes]], window: int) -> Matcher:
    """Built once for a worker, as building costs more than sending the items."""
    global _cached
    key = zlib.crc32(repr((window, items)).encode())
    if _cached is None or _cached[0] != key or _cached[1].items != items:
        matcher = Matcher(items, window)
        matcher.items = items
        _cached = (key, matcher)
    return _cached[1]


def _covered(ranges: list[tuple[int, int]]) -> int:
    total = top = 0
    for a, b in sorted(ranges):
        if b > top:
            total += b - max(a, top)
            top = b
    return total


def item_blocks(items: DataFrame, item_id: str, text: str):
    """Yields lists of (id, text) of at most BLOCK_BYTES of text, or one larger item."""
    rows = pick(items, item_id, text).toDF("item", "text").where("text is not null").select(F.col("item").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    block, size = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        if block and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item, bytes(r.text)))
        size += len(r.text)
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The kept columns and, of each document: ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items`` and ``item_ids`` (sorted), and ``contaminated``: n_hit > 0 and share * n_hit >= n_words."""
    sc = docs.sparkSession.sparkContext
    out = pick(docs, *keep, text).toDF(*keep, "text")
    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1])
    n = len(keep)
    found_type = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    scratch, held = Scratch(docs.sparkSession), None
    blocks = item_blocks(items, item_id, item_text)
    block, k = next(blocks, []), -1
    while block is not None:
        following, k = next(blocks, None), k + 1
        shared, first, last = sc.broadcast(block), k == 0, following is None
        if k and k % CHAIN == 0:
            out, before = scratch.cut(out), held
            held = out
            if before is not None:
                scratch.drop(before)

        def run(batches, shared=shared, first=first, last=last):
            matcher = _matcher(shared.value, window)
            for batch in batches:
                before = [[]] * batch.num_rows if first else batch.column(n + 1).to_pylist()
                named = [[]] * batch.num_rows if first else batch.column(n + 2).to_pylist()
                ranges, ids, counts = [], [], []
                for t, r, i in zip(utf8(batch.column(n)), before, named):
                    words = words_of(t)
                    new, items_hit = matcher.search(words)
                    counts.append(len(words))
                    ranges.append([(x["a"], x["b"]) for x in r] + new)
                    ids.append(sorted({*i, *items_hit}))
                if last:
                    hit = [_covered(r) for r in ranges]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array([h > 0 and share * h >= c for h, c in zip(hit, counts)], pa.bool_())],
                        [*keep, "n_words", "n_hit", "n_items", "item_ids", "contaminated"],
                    )
                else:
                    structs = [[{"a": a, "b": b} for a, b in r] for r in ranges]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(structs, pa.list_(found_type)), pa.array(ids, pa.list_(pa.string()))], [*keep, "text", "hits", "ids"])

        tail = "n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean" if last else "text string, hits array<struct<a: bigint, b: bigint>>, ids array<string>"
        out = map_arrow(out, run, f"{fixed}, {tail}" if fixed else tail)
        block = following
    return out


def items_digest(ids: list[str]) -> str:
    """Digest of sorted item ids, as the query returns it."""
    return sha256(",".join(ids).encode()).hexdigest()
