"""Operator 1: token counts by prefix dynamic programming.

For byte-pair encoding, a sequence of tokens is the encoding of its bytes exactly when each token alone and each pair of
neighbours encodes to itself. So each prefix of a word has one last token that fits the encoding of what stands before
it, and the count at a prefix is the count before that token plus one. Words share their prefixes' states.

A document's *profile* has a signed number of two bytes for each character: the change of the token count when the prefix grows by
that character. Its running sum is the exact number of tokens of every prefix as the library would encode that prefix,
so truncation and budget questions are answered from it without encoding again.

Defined cases: a null text is empty (0 tokens, an empty profile); strings of special tokens inside a text are one token,
as the library's default has it; rows that repeat, and null ids, are counted each; other columns of the input are not
read. A very long text is counted whole, word by word; only its own profile grows with it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

#: States of prefixes and words that a worker keeps; beyond, it starts anew (results are the same).
KEPT_PREFIXES, KEPT_WORDS, KEPT_WORD_LENGTH = 600_000, 400_000, 48
_NEVER = 1 << 60
_CONTRACTIONS = ("'re", "'ve", "'ll")
#: The split pattern of byte-level BPE, for texts whose characters mean the same to Python's re.
_WORDS = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:_|[^\w\s])+|\s+(?!\S)|\s+")
_SPACES = re.compile(r"\s{2,}")
#: Python takes these for white space too; the tokenizer's \s is Unicode's property White_Space, which they lack.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: A step of a profile.
_STEP = np.dtype("<i2")


def _is_space(text: str) -> bool:
    return text.isspace() and not any(c in _NO_SPACE for c in text)


def _plain(c: str) -> bool:
    """Whether Python's classes \\s, \\d and letters agree with Unicode's for this character."""
    kind = unicodedata.category(c)
    return c not in _NO_SPACE and kind not in ("No", "Nl", "Mn", "Mc", "Me", "Pc", "Cn") or c == "_"


_UNUSUAL = re.compile("[^" + "".join(re.escape(chr(c)) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if _plain(chr(c))) + "]")


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts at every prefix for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a byte-level BPE tokenizer without normaliser: {path}")
        self.library = Tokenizer.from_file(path)
        symbols = byte_of_symbol()
        ids = spec["model"]["vocab"]
        self.bytes_of = {ids[word]: bytes(symbols[c] for c in word) for word in ids if all(c in symbols for c in word)}
        #: Merge rank of a pair, and of each token its rank, left part and right part.
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[left] << 20 | ids[right]] = rank
            self.made.setdefault(ids[left + right], (rank, ids[left], ids[right]))
        #: The tokens by their bytes from the end: (node << 8 | byte) -> node, and the token of a node.
        self.back: dict[int, int] = {}
        self.token_of_node = [-1]
        for i, raw in self.bytes_of.items():
            node = 0
            for byte in reversed(raw):
                key = node << 8 | byte
                node = self.back.get(key, 0)
                if not node:
                    node = self.back[key] = len(self.token_of_node)
                    self.token_of_node.append(-1)
            self.token_of_node[node] = i
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[int, int]]] = {}
        self.prefixes: dict[bytes, int] = {}
        self.words: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the first byte (side 1) or the last (side 2) up to the token itself: each part and the rank of the
        merge that takes it in."""
        key = token << 2 | side
        found = self.edges.get(key)
        if found is None:
            found, ends, at = [], _NEVER, token
            while True:
                found.append((at, ends))
                if at not in self.made:
                    break
                ends, at = self.made[at][0], self.made[at][side]
            found = self.edges[key] = found[::-1]
        return found

    def _untouched(self, a: int, b: int, until: int) -> bool:
        """Whether no merge across the border of a and b comes before their own parts are taken in, nor before the
        rank ``until``. Of equal ranks the left one comes first."""
        left, right, i, j = self._edge(a, 2), self._edge(b, 1), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get(x << 20 | y)
            if rank is not None and rank < x_ends and rank <= y_ends and rank < until:
                return False
            if x_ends <= y_ends:
                if x_ends == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is these two tokens; a < 0: whether b's bytes become b."""
        key = (a + 1) << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > KEPT_PREFIXES:
                self.fits.clear()
            if a >= 0:
                found = self._stay_apart(-1, b) and self._untouched(a, b, _NEVER)
            elif b not in self.made:
                found = True
            else:
                rank, left, right = self.made[b]
                found = self._stay_apart(-1, left) and self._stay_apart(-1, right) and self._untouched(left, right, rank)
            self.fits[key] = found
        return found

    def _states(self, word: bytes) -> list[int]:
        """For each prefix: count of tokens << 20 | last token."""
        known, back, token_of_node, fits, out = self.prefixes, self.back, self.token_of_node, self.fits, [0]
        for n in range(1, len(word) + 1):
            key = word[:n] if n <= KEPT_WORD_LENGTH else None
            state = known.get(key) if key else None
            if state is None:
                node, at = 0, n
                while at:
                    at -= 1
                    node = back.get(node << 8 | word[at])
                    if node is None:
                        raise ValueError("no token ends this prefix")
                    token = token_of_node[node]
                    if token >= 0:
                        before = out[at]
                        last = before & 0xFFFFF if at else -1
                        fit = fits.get((last + 1) << 20 | token)
                        if fit or fit is None and self._stay_apart(last, token):
                            state = ((before >> 20) + 1) << 20 | token
                            break
                else:
                    raise ValueError("no token ends this prefix")
                if key:
                    known[key] = state
            out.append(state)
        return out

    def word(self, word: str) -> bytes:
        """The profile of one word of the split pattern."""
        found = self.words.get(word)
        if found is not None:
            return found
        if len(self.prefixes) > KEPT_PREFIXES:
            self.prefixes.clear()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        raw = word.encode()
        states = self._states(raw)
        if len(raw) == len(word):
            counts = [s >> 20 for s in states]
        else:
            counts, at = [0], 0
            for c in word:
                at += len(c.encode())
                counts.append(states[at] >> 20)
        if word in _CONTRACTIONS:  # a shorter prefix isn't a contraction: the apostrophe and the letter are two words
            counts[2] = counts[1] + (self._states(raw[1:2])[1] >> 20)
        changes = [b - a for a, b in zip(counts, counts[1:])]
        out = np.array(changes, _STEP).tobytes()
        if len(word) <= KEPT_WORD_LENGTH:
            self.words[word] = out
        return out

    def _split(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _WORDS.findall(text)

    def _ordinary(self, text: str) -> bytes:
        words = self._split(text)
        get = self.words.get
        parts = [get(w) or self.word(w) for w in words]
        if not _SPACES.search(text):
            return b"".join(parts)
        out, at = np.frombuffer(b"".join(parts), _STEP).astype(np.int64), 0
        for a, b in zip(words, words[1:]):
            at += len(a)
            if _is_space(a) and _is_space(b[0]):  # a prefix that ends here is one run of spaces, longer by one
                alone = int(np.frombuffer(self.word(a), _STEP).sum())
                joined = int(np.frombuffer(self.word(a + b[0]), _STEP).sum())
                change = joined - alone - int(out[at])
                out[at] += change
                if at + 1 < len(out):
                    out[at + 1] -= change
        return out.astype(_STEP).tobytes()

    def profile(self, text: str) -> bytes:
        """A signed number of two bytes for each character of the text."""
        if not self.special_at or not any(s in text for s in self.special):
            return self._ordinary(text)
        out, low = [], 0
        for found in self.special_at.finditer(text):
            before = text[low : found.start()]
            count = int(np.frombuffer(self._ordinary(before), _STEP).sum(dtype=np.int64))
            with_it = np.frombuffer(self._ordinary(before + found[0]), _STEP).copy()
            with_it[-1] = count + 1 - int(with_it[:-1].sum(dtype=np.int64))
            out.append(with_it.tobytes())
            low = found.end()
        out.append(self._ordinary(text[low:]))
        return b"".join(out)


def tokens_at(profile: bytes, chars: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(profile, _STEP)[:chars].sum(dtype=np.int64))


def chars_within(profile: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(profile, _STEP), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_token_counts(df: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text", keep_profile: bool = True) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, chars_within_budget and the profile (binary; with
    ``keep_profile=False`` it is used and left out). No shuffle; memory is bounded by an Arrow batch and the kept states."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            profiles, sizes = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                profiles.append(own.profile(text))
                sizes.append(len(text.encode()))
            counts = [int(np.frombuffer(p, _STEP).sum(dtype=np.int64)) for p in profiles]
            within = [chars_within(p, budget) if n > budget else len(p) // _STEP.itemsize for p, n in zip(profiles, counts)]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(within, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "chars_within_budget"]
            if keep_profile:
                columns.append(pa.array(profiles, pa.binary()))
                names.append("profile")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, chars_within_budget long" + ", profile binary" * keep_profile
    return df.select(id_col, text_col).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=1024, keep_profile=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "chars_within_budget")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
