"""Byte-level BPE encoding and decoding: speculate, verify, and merge only what fails.

Words (pre-tokens) that a worker has not met are first cut greedily into the longest vocabulary entries. A sequence of
tokens is the merge result exactly if every adjacent pair is: so all adjacent pairs of all new words are looked up at once
in a table of compatible pairs, and only words with an incompatible pair go through exact merging. A pair's own entry is
found once, by merging its bytes. Each worker keeps its table and its words between tasks; beyond ``most_words`` it
keeps the half that it met first and those that the slice of texts at hand uses, which bounds the memory and changes no result.

Defined cases: a null text is the empty text, which has no ids; text of a special token becomes its id, as the tokenizers
library does; repeated rows are coded alike; extra columns are kept, columns with a result's name are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.json"
MOST_WORDS = 600_000
FEW_WORDS = 120_000  # where workers hold more than one coder's tables, or those of other stages
MOST_PAIRS = 1 << 20
LONG_WORD = 256
SLICE_CHARS = 4 << 20
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts without the characters that Python's classes sort otherwise.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file: itself where it prints, else a character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Coder:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        self.most_words = most_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_symbols(), spec["model"]
        raw = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(token): k for token, k in model["vocab"].items() if token not in self.special}
        self.bytes = {k: token for token, k in self.ids.items()} | {k: s.encode() for s, k in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks, self.merged_into = {}, []
        for rank, (a, b) in enumerate(pairs):
            left, right = raw(a), raw(b)
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank
            self.merged_into.append(self.ids[left + right])
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        # The same as sorted arrays, for many words at once; the last rank stands for no merge.
        order = np.argsort(np.fromiter(self.ranks, np.int64, len(self.ranks)))
        self.rank_keys = np.fromiter(self.ranks, np.int64, len(self.ranks))[order]
        self.rank_of_key = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order]
        self.merged_ids, self.byte_table = np.array([*self.merged_into, -1]), np.array(self.byte_ids)
        # Trie of the vocabulary: sorted (node << 8 | byte) edges, the child of each, the token that ends at each node.
        nodes: dict[bytes, int] = {b"": 0}
        for token in self.ids:
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
        edges = np.array([nodes[p[:-1]] << 8 | p[-1] for p in nodes if p], np.int64)
        order = np.argsort(edges)
        self.edges, self.child = edges[order], np.arange(1, len(nodes))[order]
        self.token_at = np.array([self.ids.get(p, -1) for p in nodes], np.int64)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # ids of a blank and the text up to the next one
        self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        self.alone: dict[int, bool] = {}
        # Bit 1: white space. Bit 2: characters that Python's classes sort otherwise than the pattern.
        every = np.arange(0x110000, dtype="<u4")
        every = every[(every < 0xD800) | (every > 0xDFFF)].tobytes().decode("utf-32-le")
        self.kinds, self.odd = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
        self.kinds[[ord(c) for c in re.findall(r"\s", every)]] = 1
        self.odd[[*range(0x1C, 0x20), *(ord(c) for c in regex.findall(r"[\p{Nl}\p{No}]", every))]] = True
        self.kinds |= 2 * self.odd.astype(np.uint8)
        self.controls = re.compile("[\x1c-\x1f]")
        self.plain = re.compile(PLAIN_PATTERN)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.counts = {"words": 0, "merged": 0}

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any() or self.controls.search(text):
            return regex.findall(PATTERN, text)
        return self.plain.findall(text)

    def merge(self, word: bytes) -> list[int]:
        """Exact result: the leftmost pair of the best rank is merged until no pair has one."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        tokens, rank_of, none = [self.byte_ids[b] for b in word], self.ranks.get, len(self.merged_into)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            tokens[i : i + 2] = [self.merged_into[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(tokens[i] << 32 | tokens[i + 1], none)
            if i:
                ranks[i - 1] = rank_of(tokens[i - 1] << 32 | tokens[i], none)
        return tokens

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs, for words whose length would make repeated searches slow."""
        tokens, n = [self.byte_ids[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (rank := self.ranks.get(tokens[i] << 32 | tokens[j])) is not None:
                heapq.heappush(heap, (rank, i, tokens[i], tokens[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= n or tokens[j] != right:
                continue
            tokens[i], tokens[j], after[i] = self.merged_into[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.rank_keys, keys), len(self.rank_keys) - 1)
        return np.where(self.rank_keys[at] == keys, self.rank_of_key[at], len(self.rank_keys))

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words in step: each round merges the leftmost best pair of every unfinished word.

        The ids of all words in a row, and how many each word has.
        """
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        results = {k: np.array(self.merge(w)) for k, w in enumerate(words) if len(w) > LONG_WORD}
        tokens = self.byte_table[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        owner = np.repeat(np.array(short, np.int64), [len(words[k]) for k in short])
        none, done = len(self.rank_keys), [(np.concatenate([np.full(len(v), k) for k, v in results.items()]), np.concatenate(list(results.values())))] if results else []
        ranks = np.full(len(tokens), none)
        ranks[:-1] = np.where(owner[:-1] == owner[1:], self._rank(tokens[:-1], tokens[1:]), none)
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(owner)]]))
            best = np.minimum.reduceat(ranks, starts)
            if (best == none).any():
                going = np.repeat(best != none, sizes)
                done.append((owner[~going], tokens[~going]))
                tokens, owner, ranks = tokens[going], owner[going], ranks[going]
                sizes, best = sizes[best != none], best[best != none]
                if not len(tokens):
                    break
            place = np.flatnonzero(ranks == np.repeat(best, sizes))
            place = place[np.concatenate([[True], owner[place[1:]] != owner[place[:-1]]])]
            tokens[place] = self.merged_ids[best]
            keep = np.ones(len(tokens), bool)
            keep[place + 1] = False
            tokens, owner, ranks = tokens[keep], owner[keep], ranks[keep]
            place -= np.arange(len(place))  # every word before has lost one token
            for at in (place, place[place > 0] - 1):
                after = np.minimum(at + 1, len(tokens) - 1)
                ranks[at] = np.where((owner[at] == owner[after]) & (after > at), self._rank(tokens[at], tokens[after]), none)
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        owners = np.concatenate([o for o, _ in done])
        return np.concatenate([x for _, x in done])[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of many words in step, one byte of each word at a time.

        The ids of all words in a row, and how many each word has.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.concatenate([np.frombuffer(b"".join(words), np.uint8).astype(np.int64), [0]])
        end = np.cumsum(lengths)
        word, at = np.arange(len(words)), end - lengths
        node, best, best_end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), at.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            edge = node << 8 | text[at]
            k = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = (self.edges[k] == edge) & (at < end)
            node = np.where(on, self.child[k], 0)
            at = np.where(on, at + 1, best_end)
            token = self.token_at[node]
            ends = on & (token >= 0)
            if not on.all():
                found.append((word[~on], best[~on]))
            best, best_end = np.where(ends, token, best), np.where(ends, at, best_end)
            if (going := on | (at < end)).all():
                continue
            word, at, end, node, best, best_end = word[going], at[going], end[going], node[going], best[going], best_end[going]
        owners = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
        tokens = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        return tokens[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """For each key (left id << 32 | right id): is the pair the merge result of its own bytes?"""
        if len(self.pair_keys) > MOST_PAIRS:
            self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        new = np.setdiff1d(keys, self.pair_keys)
        if len(new):
            left, right = (new >> 32).tolist(), (new & 0xFFFFFFFF).tolist()
            ids, lengths = self.merge_many([self.bytes[a] + self.bytes[b] for a, b in zip(left, right, strict=True)])
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            fits = (lengths == 2) & (ids[first] == np.array(left)) & (ids[np.minimum(first + 1, len(ids) - 1)] == np.array(right))
            all_keys = np.concatenate([self.pair_keys, new])
            order = np.argsort(all_keys)
            self.pair_keys, self.pair_fits = all_keys[order], np.concatenate([self.pair_fits, fits])[order]
        return self.pair_fits[np.searchsorted(self.pair_keys, keys)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words."""
        raw = [w.encode() for w in words]
        flat, lengths = self.propose(raw)
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[:-1] == owner[1:]
        bad = np.zeros(len(words), bool)
        keys = (flat[:-1] << 32 | flat[1:])[inside]
        bad[owner[:-1][inside][~self._fits(keys)]] = True
        first = np.cumsum(lengths) - lengths
        for k in np.flatnonzero(lengths == 1).tolist():
            token = int(flat[first[k]])
            if token not in self.alone:
                self.alone[token] = self.merge(self.bytes[token]) == [token]
            bad[k] = not self.alone[token]
        self.counts["words"] += len(words)
        self.counts["merged"] += int(bad.sum())
        good, wrong = np.flatnonzero(~bad), np.flatnonzero(bad)
        self._keep([words[k] for k in good.tolist()], flat[np.repeat(~bad, lengths)], lengths[good])
        self._keep([words[k] for k in wrong.tolist()], *self.merge_many([raw[k] for k in wrong.tolist()]))

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        self.words.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        simple = [k for k, t in enumerate(texts) if self._is_simple(t)]
        heads, tails = [], []
        for k in simple:
            head, blank, tail = texts[k].partition(" ")
            heads.append(head)
            tails.append(tail.split(" ") if blank else [])
        used = set().union(*tails)
        self.pieces = _bounded(self.pieces, used, self.most_words)
        look = self.pieces.get
        missing = used.difference(self.pieces)
        if missing:
            self._add_pieces(list(missing))
        for k, head, tail in zip(simple, self._coded(heads), tails, strict=True):
            out[k] = head + b"".join(map(look, tail))
        rest = [(k, self.parts.split(texts[k]) if self.parts else [texts[k]]) for k in range(len(texts)) if out[k] is None]
        plain = iter(self._coded([p for _, parts in rest for p in parts if p not in self.special]))
        for k, parts in rest:
            out[k] = b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else next(plain) for p in parts)
        return out

    def _add_pieces(self, pieces: list[str]) -> None:
        """Ids of new pieces, a blank before each: split as one text, whose words with a blank begin the pieces."""
        words = self.plain.findall(" " + " ".join(pieces))
        used = set(words)
        self.words = _bounded(self.words, used, self.most_words)
        if new := used.difference(self.words):
            self._learn(list(new))
        coded = list(map(self.words.__getitem__, words))
        begins = np.fromiter(map(str.startswith, words, repeat(" ")), bool, len(words))
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        starts = np.concatenate([[0], ends[:-1]])[begins].tolist()
        joined = b"".join(coded)
        bounds = zip(starts, [*starts[1:], len(joined)], strict=True)
        self.pieces.update(zip(pieces, [joined[a:b] for a, b in bounds], strict=True))

    def _is_simple(self, text: str) -> bool:
        """Can the text be cut before each blank? So if no white space touches other white space or an end."""
        if not text or (self.parts and self.parts.search(text)):
            return False
        kind = self.kinds[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        return not (kind[0] | kind[-1] | (kind[1:] & kind[:-1])).any() and not (kind & 2).any()

    def _coded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, word by word."""
        words = [self._split(t) for t in texts]
        used = set().union(*words)
        self.words = _bounded(self.words, used, self.most_words)
        if new := used.difference(self.words):
            self._learn(list(new))
        look = self.words.__getitem__
        return [b"".join(map(look, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _bounded(known: dict[str, bytes], used: set[str], most: int) -> dict[str, bytes]:
    """``known``; if it has grown beyond ``most``, the half that was met first (frequent words are) and what is ``used``."""
    if len(known) <= most:
        return known
    kept = dict(islice(known.items(), most // 2))
    kept.update((w, known[w]) for w in used & known.keys())
    return kept


@lru_cache(maxsize=4)
def coder(vocabulary: str = VOCABULARY, most_words: int = MOST_WORDS) -> Coder:
    """The worker's coder: ``vocabulary`` is a path, or the name of a file of the installed tokenizers package."""
    import os

    if os.path.isabs(vocabulary):
        return Coder(vocabulary, most_words)
    import public_tokenizers

    return Coder(public_tokenizers.path(vocabulary), most_words)


def slices(batch: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_CHARS characters each, to bound the memory of a step."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def _with_column(docs: DataFrame, name: str, kind: T.DataType, source: str, convert) -> DataFrame:
    """``docs`` with a column that ``convert(list of values)`` makes from ``source``, slice by slice."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    made = pa.string() if isinstance(kind, T.StringType) else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source)).to_pylist()
            for a, b in slices(batch, [v or "" for v in values]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(convert(values[a:b]), made)], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit integers."""
    return _with_column(docs, "ids", T.BinaryType(), text, lambda values: coder(vocabulary).encode([v or "" for v in values]))


def decode(coded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of its ids."""
    return _with_column(coded, "decoded", T.StringType(), ids, lambda values: [coder(vocabulary).decode(v or b"") for v in values])


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and their text ``decoded`` in place of the text: one worker does both with one coder."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")])
    own = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*own, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(vocabulary, FEW_WORDS)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values = [v or "" for v in batch.column(at).to_pylist()]
            kept = [k for k in range(batch.num_columns) if k != at]
            for a, b in slices(batch, values):
                ids = both.encode(values[a:b])
                part = batch.slice(a, b - a)
                made = [pa.array(ids, pa.binary()), pa.array([both.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op7: all documents encoded and decoded again."""
    from plumbline.llm.common import table

    rows = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
