"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never be merged over, so a word
is cut between them for certain. The fragments are encoded apart, and their ids put end to end are the
encoding of the whole; fragments and words recur, so both are remembered in bounded tables.

The vocabulary is a tokenizer file (JSON) with byte-level symbols and an optional end-of-word suffix;
texts are normalised as the file asks for: composed (NFC), white space dropped, lower case, with the
file's special tokens recognised in the text first.

Defined results: a null or empty text, or one of white space only, has no tokens and decodes to an empty
string. Very long texts and words are encoded whole; a fragment of n bytes takes O(n log n) steps.
Repeated rows are encoded one by one alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sylva.llm.common import map_arrow, pick

#: Entries of the tables of words and fragments; a full table starts anew.
TABLE = 400_000
LONG = 48
# The code points with the Unicode property White_Space.
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACES = regex.compile("[" + "".join(map(chr, _WHITE)) + "]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ForcedBpe:
    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        model = data["model"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]] if data.get("normalizer") else []
        if model["type"] != "BPE" or sorted(kinds) != ["Lowercase", "NFC", "Replace"] or data.get("decoder"):
            raise ValueError("only lower-casing byte-level BPE files without a decoder are supported")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", ())}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a.removesuffix(self.suffix) + b if self.suffix and a.endswith(self.suffix) and a not in self.vocab else a + b])
        self.inside = {t[i : i + 2] for t in self.vocab for bare in [len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) else len(t)] for i in range(bare - 1)}
        symbols = byte_symbols()
        self.symbol = [symbols[b] for b in range(256)]
        pre = next(x for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(pre["pattern"]["Regex"])
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, tuple[str, str]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def fragments(self, symbols: str) -> list[str]:
        """Cut between neighbours that no token holds side by side."""
        out, start = [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in self.inside:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        merges = self.merges
        if len(ids) <= LONG:
            none = (len(merges), 0)
            open_ = [merges.get(x, none) for x in zip(ids, ids[1:])]
            while open_:
                best = min(open_)
                if best is none:
                    break
                at = open_.index(best)
                ids[at : at + 2] = [best[1]]
                del open_[at]
                if at:
                    open_[at - 1] = merges.get((ids[at - 1], best[1]), none)
                if at < len(open_):
                    open_[at] = merges.get((best[1], ids[at + 1]), none)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def _fragment(self, fragment: str, last: bool) -> tuple[int, ...]:
        key = fragment + " " if last else fragment  # no symbol is a space
        got = self.parts.get(key)
        if got is None:
            ids = [self.vocab[c] for c in fragment]
            if last:
                ids[-1] = self.vocab[fragment[-1] + self.suffix]
            got = tuple(self._merge(ids))
            if len(fragment) <= LONG:
                if len(self.parts) >= TABLE:
                    self.parts.clear()
                self.parts[key] = got
        return got

    def _word(self, word: str) -> tuple[str, str]:
        """Decimal ids and symbols, joined by spaces, of a word of the pre-tokenizer."""
        if word.isascii() and word.isprintable():
            symbols = word
        else:
            symbols = "".join([self.symbol[b] for b in word.encode()])
        parts = self.fragments(symbols)
        ids: list[int] = []
        for p in parts[:-1]:
            ids += self._fragment(p, False)
        ids += self._fragment(parts[-1], True)
        return self._keep(word, (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])))

    def _keep(self, key: str, got: tuple[str, str]) -> tuple[str, str]:
        if len(key) <= LONG:
            if len(self.words) >= TABLE:
                self.words.clear()
            self.words[key] = got
        return got

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter, without the final form
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python splits at these, Unicode's White_Space has them not
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def _known(self, chunk: str) -> tuple[str, str]:
        """As ``_word``, for a run of normalised text without white space."""
        get = self.words.get
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.split.findall(chunk)
        if words == [chunk]:
            return self._word(chunk)
        parts = [get(w) or self._word(w) for w in words]
        return self._keep(chunk, (" ".join([x[0] for x in parts]), " ".join([x[1] for x in parts])))

    def texts(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        if not text:
            return "", ""
        pieces, at = [], 0
        if self.find_special and "<" in text:
            for m in self.find_special.finditer(text):
                pieces += [(text[at : m.start()], None), (m.group(), self.special[m.group()])]
                at = m.end()
        pieces.append((text[at:], None))
        out: list[tuple[str, str]] = []
        get = self.words.get
        for piece, special in pieces:
            if special is not None:
                out.append((str(special), piece))
            else:
                out += [get(c) or self._known(c) for c in self._chunks(piece)]
        out = [x for x in out if x[0]]
        return " ".join([x[0] for x in out]), " ".join([x[1] for x in out])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.texts(text)[0].split()))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


_loaded: dict[str, ForcedBpe] = {}


def tokenizer(spec: bytes) -> ForcedBpe:
    """One tokenizer for a worker and file, with its tables."""
    key = sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ForcedBpe(spec)
    return _loaded[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The kept columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on request, ``token_ids``.

    The driver reads the file; its content (a vocabulary, a few MB whatever the corpus) is broadcast.
    """
    rows = pick(docs, *keep, text).toDF(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    n = len(keep)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    def run(batches):
        bpe = tokenizer(shared.value)
        for batch in batches:
            counts, ids_hash, text_hash, all_ids = [], [], [], []
            for t in batch.column(n).to_pylist():
                ids, decoded = bpe.texts(t or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(sha256(ids.encode()).hexdigest())
                text_hash.append(sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids.split(), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash), *[pa.array(all_ids, pa.list_(pa.int32()))] * with_ids], names)

    fixed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{fixed}n_tokens long, ids_sha256 string, decoded_sha256 string{', token_ids array<int>' if with_ids else ''}")
