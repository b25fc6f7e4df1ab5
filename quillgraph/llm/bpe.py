"""Byte-pair encoding and decoding: speculate, verify, merge only what fails.

A word's tokens are first guessed by greedy longest match. A guess is the true
encoding if and only if each adjacent pair of tokens is compatible: were the two parts
encoded together, no merge across their border would come before the merges that built
them. All pairs of all new words of a batch are checked at once with numpy; words with a
failing pair, and only those, are merged exactly (a heap over a linked list, so a very
long word costs n log n). Results are kept per distinct word in a bounded table.

The vocabulary is a byte-level tokenizer file read by its path on each worker; it is
neither trained nor copied here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table

#: Distinct words a worker remembers, and the longest it does.
CACHE_WORDS = 300_000
CACHE_CHARS = 48
#: Words of up to so many bytes are merged by scanning for the least rank.
SHORT = 40
NO_MERGE = (1 << 62, -1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the
    others, in order, for the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file. Ranks are merge places; bytes have rank -1."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        n = 1 + max([*vocab.values(), *special.values()])
        self.bytes_of: list[bytes] = [b""] * n
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            a, b = plain(a), plain(b)
            i, j, c = vocab[a], vocab[b], vocab[a + b]
            if (i, j) not in self.merge:
                self.merge[i, j] = (k, c)
                if self.left[c] == c:
                    self.rank[c], self.left[c], self.right[c] = k, i, j
        self.size = n
        keys = np.fromiter((a * n + b for a, b in self.merge), np.int64, len(self.merge))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter((r for r, _ in self.merge.values()), np.int64, len(keys))[order]
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        #: Only tokens that merging can reach may be guessed.
        self.guess = {b: i for b, i in vocab.items() if self.exact(b) == [i]}
        self.longest = max(map(len, self.guess))
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.seen: dict[str, tuple[str, int, bytes]] = {}

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n, merge = len(ids), self.merge
        if n <= SHORT:
            ranked = [merge.get(p, NO_MERGE) for p in zip(ids, ids[1:])]
            while ranked and (best := min(ranked)) is not NO_MERGE:
                i = ranked.index(best)
                ids[i : i + 2] = [best[1]]
                del ranked[i]
                if i:
                    ranked[i - 1] = merge.get((ids[i - 1], best[1]), NO_MERGE)
                if i < len(ranked):
                    ranked[i] = merge.get((best[1], ids[i + 1]), NO_MERGE)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The guess: the longest token at each place."""
        out, at, n, guess = [], 0, len(word), self.guess
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := guess.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b; beyond all ranks where they don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the two tokens' bytes together gives these two tokens.

        Walks back in time from the border (a, b): each step undoes the later of the
        merges that made the two tokens at the border (the right one where equal: the
        left is merged first), which shows the pair that met there before. That pair
        must not merge before the undone merge takes one of its sides: not at a lower
        rank, nor at the same one where the undone merge is to its right."""
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        live = np.arange(len(a))
        ok[self.pair_rank(a, b) != np.iinfo(np.int64).max] = False
        live = live[ok[live]]
        while len(live):
            x, y = a[live], b[live]
            undo_left = self.rank[x] > self.rank[y]
            limit = np.where(undo_left, self.rank[x], self.rank[y])
            more = limit >= 0
            live, x, y, undo_left, limit = live[more], x[more], y[more], undo_left[more], limit[more]
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            cross = self.pair_rank(x, y)
            bad = np.where(undo_left, cross < limit, cross <= limit)
            ok[live[bad]] = False
            a[live], b[live] = x, y
            live = live[~bad]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Guess all, check all adjacent pairs at once, merge the failing ones."""
        guesses = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
        if len(inner):
            bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
            for w in np.unique(owner[bad]):
                guesses[w] = self.exact(words[w])
        return guesses

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Words of each text by the public pattern; special strings stay whole."""
        out = []
        for text in texts:
            if self.split_special is None or not any(s in text for s in self.special):
                out.append(self.words.findall(text))
                continue
            own, at = [], 0
            for m in self.split_special.finditer(text):
                own += self.words.findall(text[at : m.start()])
                own.append(m[0])
                at = m.end()
            out.append(own + self.words.findall(text[at:]))
        return out

    def known(self, pieces: list[list[str]]) -> dict[str, tuple[list[int], str, bytes]]:
        """(ids, ids as text, their bytes) of all words of the pieces at least."""
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = list(set().union(*pieces).difference(self.seen)) if pieces else []
        for word, ids in zip(new, self.encode_words([w.encode() for w in new])):
            if word in self.special:
                ids = [self.special[word]]
            self.seen[word] = (ids, ",".join(map(str, ids)), self.decode_bytes(ids))
        return self.seen

    def forget_long(self, pieces: list[list[str]]) -> None:
        for own in pieces:
            for w in own:
                if len(w) > CACHE_CHARS:
                    self.seen.pop(w, None)

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = self.pieces(texts)
        seen = self.known(pieces)
        return [[i for p in own for i in seen[p][0]] for own in pieces]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with a column `ids` (array of int) for their whole text; a null
    text is empty and has no ids. A column ids that is there already is replaced."""
    path = path or default_vocabulary()
    docs = docs.drop("ids")
    names = docs.columns
    schema = docs.withColumn("ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode([t or "" for t in batch.column(names.index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    return docs.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip): whole texts encoded, and whether
    the ids decode to the text again; a null text is empty."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for at in range(0, len(texts), 64):
                own = texts[at : at + 64]
                pieces = v.pieces(own)
                seen = v.known(pieces)
                ids = [[i for p in x for i in seen[p][0]] for x in pieces]
                same = [b"".join([seen[p][2] for p in x]).decode("utf-8", "replace") == t for x, t in zip(pieces, own)]
                v.forget_long(pieces)
                part = batch.slice(at, len(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                    names=["doc_id", "source", "n_tokens", "ids", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows with doc_id and ids; null ids decode to null."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids.

    Decoding joins the bytes of the ids' tokens, word by word, so it is done once for
    each distinct word; null and empty texts have no ids; repeated rows are kept."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n_tokens, ids_sha, decoded_sha = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 64):
                pieces = v.pieces(texts[at : at + 64])
                seen = v.known(pieces)
                for own in pieces:
                    rows = [seen[p] for p in own]
                    n_tokens.append(sum([len(r[0]) for r in rows]))
                    ids_sha.append(hashlib.sha256(",".join([r[1] for r in rows]).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([r[2] for r in rows]).decode("utf-8", "replace").encode()).hexdigest())
                v.forget_long(pieces)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    small_batches(spark)
    return digest_documents(table(spark, sf_dir, "documents"))
