"""BPE encoding and decoding with a contiguous rank array per word.

``BpeCodec`` reads a public tokenizer file (NFC, white space and case
normalisation, a word pattern, byte symbols, ``</w>`` word ends).  A word is
encoded on two flat lists, its part boundaries and the merge rank of each
adjacent pair: scan for the smallest rank, delete that boundary, refresh the
two neighbouring ranks, repeat.  Words of more than ``SHORT`` parts use a heap
over the same ranks, since the scan is quadratic in the word.

Defined cases: null text counts as empty; empty text has 0 tokens and decodes
to ''; special-token strings inside a text become their ids, as in the
library; code points newer than Python's Unicode are read as the library reads
them; repeated rows are encoded each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import map_text, table

SHORT = 96
#: Words kept with their encoding per Python worker, in each of two generations: a full one becomes the old one.
CACHE_WORDS = 200_000
#: White space as the library's pattern engine sees it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_LATE = regex.compile("[^\x00-\u0557]")  # where versions() may matter
_NONE = 1 << 60
_NO_RANK = 2**31 - 1


@dataclass
class Versions:
    """Where Python, the pattern module and the library follow different versions of Unicode."""

    inert: regex.Pattern  # marks that the library's NFC takes for plain characters
    rest: regex.Pattern  # what lies between those
    odd: regex.Pattern  # newer than ``unicodedata``, letters or numbers to the pattern module
    pieces: regex.Pattern  # the pattern that classes those as the library does
    lower: dict[int, str]  # and their lower case there


def _set(chars) -> str:
    """The characters as the inside of a bracketed set (never empty)."""
    return "".join(map(regex.escape, sorted(chars))) or "\\n"


@lru_cache(maxsize=1)
def versions() -> Versions:
    """The library itself is asked, once per worker, about the code points that not all versions know."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    nfc, lower = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str
    low, high = "\u0334", "\u0345"  # marks of the smallest and the largest class: any other mark moves before or behind one of them
    inert = {c for c in every if unicodedata.combining(c) and nfc(c + low) == c + low and nfc(high + c) == high + c and c not in (low, high)}
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == c != nfc(pair):
                inert.add(pair[1])
    odd = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in every if unicodedata.category(c) == "Cn"))
    lines, other = "\n".join(odd), {}
    for kind in "LN":  # those that the library doesn't count to the class
        left = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed").pre_tokenize_str(lines)
        other[kind] = set("".join(part for part, _ in left)) - {"\n"}
    pieces = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_set(other['L'])}]]+|[\p{{N}}--[{_set(other['N'])}]]|[[^{_SPACE}\p{{L}}\p{{N}}]||[{_set(other['L'] & other['N'])}]--[\n]]+"
    return Versions(
        regex.compile(f"[{_set(inert)}]"), regex.compile(f"[^{_set(inert)}]+"), regex.compile(f"[{_set(odd)}]"), regex.compile(pieces), {ord(c): x for c in odd if (x := lower(c)) != c}
    )


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class BpeCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[int, int] = {}  # of a pair, coded as one number
        self.made: list[int] = []  # id that a rank's merge makes
        for a, b in pairs:
            self.rank.setdefault(self.vocab[a] << 20 | self.vocab[b], len(self.made))
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.byte_id = [self.vocab[s] for s in symbols]
        self.last_id = [self.vocab[s + self.end] for s in symbols]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_ids, self.last_ids, self.made_ids = (np.array(x, dtype=np.int32) for x in (self.byte_id, self.last_id, self.made))
        self.pair_codes = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[c] for c in self.pair_codes.tolist()], dtype=np.int32)
        self.cache: dict[str, tuple[int, str, str]] = {}  # by word of the pattern
        self.old: dict[str, tuple[int, str, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.byte_id[b] for b in raw[:-1]] + [self.last_id[raw[-1]]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        ranks = [rank.get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            parts[i] = new = made[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(new << 20 | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 20 | new, _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = lambda x, y: self.rank.get(parts[x] << 20 | parts[y]) if parts[x] >= 0 else None
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := found(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := found(x, y)) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _scan_many(self, words: list[bytes]) -> list[list[int]]:
        """``_scan`` for words of one padded length at once: each step merges the leftmost smallest rank of every word."""
        n, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        column, row = np.arange(width), np.arange(n)
        parts = np.where(column == (size - 1)[:, None], self.last_ids[raw], self.byte_ids[raw])
        parts[column >= size[:, None]] = -1
        ranks = np.full((n, width), _NO_RANK, dtype=np.int32)  # of the pair that starts here; the last column never has one
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        out: list[list[int]] = [[]] * n
        while n:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(n), at]
            done = best == _NO_RANK
            if done.any():
                for k, ids in zip(row[done].tolist(), parts[done].tolist()):
                    out[k] = [i for i in ids if i >= 0]
                go = ~done
                parts, ranks, row, at, best = parts[go], ranks[go], row[go], at[go], best[go]
                n = len(row)
                if not n:
                    break
            new, i = self.made_ids[best], np.arange(n)
            gone = column[:-1] > at[:, None]  # everything right of the boundary that goes moves one place to the left
            parts[:, :-1] = np.where(gone, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(gone, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NO_RANK
            parts[i, at] = new
            right = np.where(at + 1 < width, parts[i, np.minimum(at + 1, width - 1)], -1)
            ranks[i, at] = self._ranks(new, right)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(parts[left, at[left] - 1], new[left])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) << 20 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NO_RANK).astype(np.int32)

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Puts the encodings of words of the pattern into the cache."""
        if len(self.cache) >= CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        cache, old, raw = self.cache, self.old, []
        for w in words.difference(cache):
            if (known := old.get(w)) is not None:
                cache[w] = known
            else:
                raw.append((w, w.encode("utf-8", "surrogatepass")))
        for lo, hi in ((1, 8), (9, 16), (17, SHORT)):
            some = [x for x in raw if lo <= len(x[1]) <= hi]
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                cache.update(zip([w for w, _ in part], map(self._entry, self._scan_many([b for _, b in part]))))
        cache.update((w, self._entry(self.encode_word(w))) for w, b in raw if len(b) > SHORT)

    def _words(self, text: str) -> list[str]:
        late = _LATE.search(text) is not None
        if late and versions().inert.search(text):
            text = versions().rest.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.replace("\u03a3", "\u03c3").lower()  # lower() alone would look at the word's end
        if late and versions().odd.search(text):
            return versions().pieces.findall(text.translate(versions().lower))
        return _PIECES.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """For each text the (count, ids, tokens) of its words, in order."""
        split = []  # per text: lists of words, with special tokens between them
        for t in texts:
            t, parts, at = t or "", [], 0
            if self.special and "<|" in t:
                for m in self.split_special.finditer(t):
                    parts += [self._words(t[at : m.start()]), m[0]]
                    at = m.end()
            split.append([*parts, self._words(t[at:] if at else t)])
        self.learn(set().union(*(p for parts in split for p in parts if isinstance(p, list))))
        cache, out = self.cache, []
        for parts in split:
            found: list[tuple[int, str, str]] = []
            for p in parts:
                found += [cache[w] for w in p] if isinstance(p, list) else [(1, str(self.special[p]), p)]
            out.append(found)
        return out

    def encode_parts(self, text: str | None) -> list[tuple[int, str, str]]:
        return self.encode_batch([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space, word ends and byte symbols as they are."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    """One codec per Python worker and file."""
    return BpeCodec(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256, decoded_sha256 (and the ids as an array with ``with_ids``), one row per row."""
    fields = [f for f in docs.select(*keep).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, a, b, ids = [], [], [], []
        for parts in c.encode_batch(batch.column(len(fields)).to_pylist()):
            joined = " ".join([p[1] for p in parts])
            n.append(sum([p[0] for p in parts]))
            a.append(hashlib.sha256(joined.encode()).hexdigest())
            b.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            if with_ids:
                ids.append([int(i) for i in joined.split()])
        cols = [batch.column(i) for i in range(len(fields))] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = [f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_text(docs.select(*keep, F.col(text).alias("__text")), "__text", run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
