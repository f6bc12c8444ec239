"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Prefix-sharing trie traversal. The distinct words of a batch are walked in byte order, depth first, as the paths of a trie;
at each node stands the last token of the encoding of the bytes up to there. By the theory of backtracking encoders (van
Antwerpen and Neubeck, 2024), that token is the only one that ends there and is compatible with the last token of the
prefix before it, where two tokens are compatible if the merges would not join or change them. A shared prefix is thus
encoded once, and a word's encoding is read off by going back from its end. Compatibility of a pair is worked out once.

Ids are defined for all texts: null and empty texts have an empty list. Special tokens are never made; text that spells one is
ordinary text. Other columns aren't touched.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges, as the tokenizers' description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(extra)] = b
            extra += 1
    return out


def _merge_by_rank(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class TrieEncoder:
    """Encodes words with the vocabulary of ``path``: a JSON file of byte-level BPE, or a file of ranks (``.tiktoken``)."""

    def __init__(self, path: str, keep: int = 200_000) -> None:
        self.keep = keep
        if path.endswith(".json"):
            model = json.load(open(path, encoding="utf-8"))["model"]
            letters = _byte_letters()
            to_bytes = {w: bytes(letters[ch] for ch in w) for w in model["vocab"] if all(ch in letters for ch in w)}
            self.vocab = {to_bytes[w]: n for w, n in model["vocab"].items() if w in to_bytes}
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            merges = [(to_bytes[a], to_bytes[b]) for a, b in pairs]
        else:
            self.vocab = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
            merges = [tuple(_merge_by_rank(w, self.vocab, r)) for w, r in sorted(self.vocab.items(), key=lambda x: x[1]) if len(w) > 1]
        # order of merges: single bytes first, then each merge as it comes
        self.order: dict[int, int] = {n: 0 for w, n in self.vocab.items() if len(w) == 1}
        self.split: dict[int, tuple[int, int]] = {n: (n, n) for w, n in self.vocab.items() if len(w) == 1}
        self.joined: dict[tuple[int, int], int] = {}
        for k, m in enumerate(merges, 1):
            if len(m) == 2 and (n := self.vocab.get(m[0] + m[1])) is not None and n not in self.split:
                pair = (self.vocab[m[0]], self.vocab[m[1]])
                self.joined[pair], self.split[n], self.order[n] = n, pair, k
        sizes: dict[bytes, set[int]] = {}
        for w, n in self.vocab.items():
            if n in self.split:
                sizes.setdefault(w[-2:], set()).add(len(w))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, array] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the bytes of token ``a`` then ``b`` as these two tokens.

        The merges across the border are undone from the latest to the earliest; no pair that meets at the border may have been
        joined by a merge that comes before the one undone last.
        """
        order, split, joined = self.order, self.split, self.joined
        limit = float("inf")
        while True:
            n = joined.get((a, b))
            if n is not None and order[n] < limit:
                return False
            whole_a, whole_b = split[a][1] == a and split[a][0] == a, split[b][0] == b and split[b][1] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or order[a] > order[b]):
                limit, a = order[a], split[a][1]
            else:
                # at the same place, the merge within b comes after one at the border
                limit, b = order[b] + 0.5, split[b][0]

    def add(self, words: Iterable[str]) -> None:
        """Encodes the words that aren't known yet, by one walk."""
        new = sorted({(w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.words})
        if len(self.words) + len(new) > self.keep:
            kept = set(words)
            self.words = {w: v for w, v in self.words.items() if w in kept}
        if len(self.compatible) > 8 * self.keep:  # pairs are worked out again when they come again
            self.compatible.clear()
        vocab, sizes, compatible, split = self.vocab, self.sizes, self.compatible, self.split
        last: list[int] = [-1]  # by depth: the last token of the path to there
        back: list[int] = [0]  # by depth: where that token begins
        before = b""
        for key, word in new:
            whole = vocab.get(key)
            if whole is not None and whole in split:
                self.words[word] = array("i", (whole,))
                continue
            depth = 0
            most = min(len(before), len(key))
            if before[:most] == key[:most]:
                depth = most
            else:
                while before[depth] == key[depth]:
                    depth += 1
            before = key
            del last[depth + 1 :], back[depth + 1 :]
            for d in range(depth + 1, len(key) + 1):
                ends = sizes.get(key[d - 2 : d] if d > 1 else key[:1], ())
                for size in ends:
                    start = d - size
                    if start < 0:
                        continue
                    t = vocab.get(key[start:d])
                    if t is None:
                        continue
                    if start:
                        pair = (last[start], t)
                        ok = compatible.get(pair)
                        if ok is None:
                            ok = compatible[pair] = self._may_follow(*pair)
                        if not ok:
                            continue
                    break
                else:
                    t, start = vocab[key[d - 1 : d]], d - 1
                last.append(t)
                back.append(start)
            ids, d = array("i"), len(key)
            while d:
                ids.append(last[d])
                d = back[d]
            ids.reverse()
            self.words[word] = ids

    def encode(self, texts: list[str | None]) -> list[array]:
        split = [_SPLIT.findall(t) if t else [] for t in texts]
        self.add({w for ws in split for w in ws})
        out = []
        known = self.words
        for ws in split:
            ids = array("i")
            for w in ws:
                ids.extend(known[w])
            out.append(ids)
        return out


_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder for each vocabulary and Python worker."""
    return TrieEncoder(path)


def pieces(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters, so that a batch of long texts needs no more memory."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > most:
            yield run
            run, size = [], 0
    if run:
        yield run


def shared_path(spark: SparkSession, folder: str, vocabulary: str) -> Callable[[], str]:
    """Where a worker finds the vocabulary: in ``folder``, or where that isn't on its machine, in the files that Spark sends from the driver's."""
    path = os.path.join(folder, vocabulary)
    if not spark.sparkContext.master.startswith("local") and os.path.exists(path):
        spark.sparkContext.addFile(path)

    def find() -> str:
        return path if os.path.exists(path) else SparkFiles.get(vocabulary)

    return find


def token_ids(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """``<key_col>, ids``: the token ids of each row's text, without special tokens. Rows are kept as they are, repeated ones too; null and empty texts have an empty list."""
    path = shared_path(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path())
        for b in batches:
            done = 0
            for texts in pieces(b.column(1).to_pylist()):
                ids = e.encode(texts)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = array("i")
                for x in ids:
                    flat.extend(x)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(ids)), lists], names=[key_col, "ids"])
                done += len(ids)

    kind = df.schema[key_col].dataType.simpleString()
    return df.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"`{key_col}` {kind}, ids array<int>")
