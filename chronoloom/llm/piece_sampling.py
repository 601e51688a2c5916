"""Operator 3: SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut into words at spaces as the model does (a space is the piece symbol U+2581 and begins a word; runs of
spaces are words of their own). Over each word stands the lattice of the model's pieces. A piece has weight
1 / (rank + RANK_OFFSET) by its rank in the model, a byte piece BYTE_WEIGHT. Forward filtering gives the total weight of
every prefix of a word; backward sampling draws the last piece of what is left with its exact probability, until nothing
is left. So a whole segmentation has probability proportional to the product of its pieces' weights. All words of a batch
are drawn at once, a piece at a time. The random numbers come from the row's key, the word's place and the step, so the
same key and text give the same pieces on any partitioning.

Characters that aren't in the model, U+2581 itself and pieces of several words are spelt in byte pieces, so decoding gives
back every text exactly (no normalisation is applied; one space is put in front, as the model does, and taken off).

Defined cases: a null text has null pieces and decodes to null; an empty text has the one piece of the leading space;
a null key counts as 0, and rows that repeat have the same pieces; other columns are not read; ``decode`` replaces a
column that has the name of its result. Texts are read whole, and words of any length, in one task each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mix, small_batches, steps

SPACE = "▁"
RANK_OFFSET, BYTE_WEIGHT = 10.0, 1e-6
#: Characters of the texts that are drawn at once; a longer text is a step of its own. Bounds a worker's memory.
STEP_CHARS = 1 << 20
_WORDS = re.compile(f"{SPACE}?[^{SPACE}\n]+|\n|{SPACE}+(?={SPACE}[^{SPACE}\n])|{SPACE}+")


class Lattice:
    """The model's pieces by their characters from the end, as a sorted table: node << 21 | character -> node."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.piece_text = [self.model.id_to_piece(i) for i in range(size)]
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not self.model.is_byte(i) for i in self.byte):
            raise ValueError(f"the model has no byte pieces: {path}")
        byte_ids = set(self.byte)
        normal = [i for i in range(size) if i not in byte_ids and not self.model.is_control(i) and not self.model.is_unknown(i)]
        back: dict[int, int] = {}
        piece_of_node, weight = [-1], np.zeros(size)
        for i in normal:
            node = 0
            for c in reversed(self.piece_text[i]):
                key = node << 21 | ord(c)
                node = back.get(key, 0)
                if not node:
                    node = back[key] = len(piece_of_node)
                    piece_of_node.append(-1)
            piece_of_node[node] = i
            weight[i] = 1 / (max(0.0, -self.model.get_score(i)) + RANK_OFFSET)
        self.keys = np.array(sorted(back), np.int64)
        self.next = np.array([back[k] for k in self.keys.tolist()], np.int64)
        self.piece_of_node, self.weight = np.array(piece_of_node), weight
        self.single = np.array(sorted(ord(self.piece_text[i]) for i in normal if len(self.piece_text[i]) == 1))
        self.longest = max(len(self.piece_text[i]) for i in normal)

    def forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of all words at once, a character at a time. Of the states (prefixes) in order: keys of the
        incoming pieces (state << 32 | share of the forward weight up to and with that piece, in 2^-31), the pieces
        (below 0: the character in bytes) and the states before (-1: the word's start); and each word's last state.
        A forward weight is kept with an exponent of its own, so words of any length stay in the range of a double.
        Shares are whole numbers that don't depend on the other words, so draws don't either."""
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        low = np.cumsum(size) - size  # state of a word's first n characters: low + n - 1
        weights, power, whole = np.zeros(len(code)), np.zeros(len(code), np.int64), np.zeros(len(code))
        parts: list[tuple] = []
        for n in range(1, int(size.max(initial=0)) + 1):
            row = np.flatnonzero(size >= n)
            own, total, live, node = low[row] + n - 1, np.zeros(len(row)), np.arange(len(row)), np.zeros(len(row), np.int64)
            scale = power[own - 1] if n > 1 else np.zeros(len(row), np.int64)  # that of the state before
            for k in range(1, min(n, self.longest) + 1):
                key = node << 21 | code[own[live] - k + 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                live, node = live[hit], self.next[at[hit]]
                if not len(live):
                    break
                piece = self.piece_of_node[node]
                ends = piece >= 0
                if ends.any():
                    who, what = live[ends], piece[ends]
                    before = own[who] - k
                    total[who] += (np.ldexp(weights[before], power[before] - scale[who]) if k < n else np.ldexp(1.0, -scale[who])) * self.weight[what]
                    parts.append((own[who].astype(np.int32), total[who], what.astype(np.int32), before.astype(np.int32) if k < n else np.full(len(who), -1, np.int32)))
            letter = code[own]
            place = np.minimum(np.searchsorted(self.single, letter), len(self.single) - 1)
            who = np.flatnonzero(self.single[place] != letter)
            if len(who):
                before = own[who] - 1
                total[who] += (weights[before] if n > 1 else 1.0) * BYTE_WEIGHT
                parts.append((own[who].astype(np.int32), total[who], (-1 - letter[who]).astype(np.int32), before.astype(np.int32) if n > 1 else np.full(len(who), -1, np.int32)))
            whole[own] = total
            weights[own], more = np.frexp(total)
            power[own] = scale + more
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none, low
        state, partial, piece, before = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(state, kind="stable")
        state, piece, before = state[order], piece[order], before[order]
        share = np.floor(partial[order] / whole[state] * (1 << 31)).astype(np.int64)
        share[np.append(state[1:] != state[:-1], True)] = 1 << 31
        return state.astype(np.int64) << 32 | share, piece, before, low + size - 1


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text)


#: Stands for a U+2581 of the text while spaces are written with that symbol; a lone surrogate, which no text has.
_OWN_MARK = "\udfff"


class Sampler:
    def __init__(self, path: str):
        self.lattice = Lattice(path)

    def encode(self, row_keys: list[int], texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text."""
        number: dict[str, int] = {}
        found, counts = [], []
        for text in texts:
            words = [] if text is None else words_of(SPACE + text.replace(SPACE, _OWN_MARK).replace(" ", SPACE))
            found += [number.setdefault(w, len(number)) for w in words]
            counts.append(len(words))
        keys, piece, before, last = self.lattice.forward(list(number))
        state = last[np.array(found, np.int64)] if found else np.zeros(0, np.int64)
        count = np.array(counts, np.int64)
        seed = mix(np.array([(k or 0) & (2**64 - 1) for k in row_keys], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        place = np.arange(len(state)) - np.repeat(np.cumsum(count) - count, count)
        seed = mix(np.repeat(seed, count) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, order, drawn = np.arange(len(state), dtype=np.int32), [], []
        step = 0
        while len(live):
            step += 1
            u = (mix(seed[live] + np.uint64(step * 0xD1342543DE82EF95 & (2**64 - 1))) >> np.uint64(33)).astype(np.int64)
            at = np.searchsorted(keys, state[live] << 32 | u, "right")
            drawn.append(piece[at])
            order.append(live)
            state[live] = before[at]
            live = live[state[live] >= 0]
        if not order:
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        word, ids = np.concatenate(order[::-1]), np.concatenate(drawn[::-1])  # the last draw is a word's first piece
        ids = ids[np.argsort(word, kind="stable")]
        sizes = np.bincount(word, minlength=len(found))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(count)])]
        return [None if t is None else self._spelt(ids[a:b]) for t, a, b in zip(texts, bounds[:-1], bounds[1:])]

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece become byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32)
        out, low = [], 0
        for i in odd.tolist():
            c = chr(-1 - int(ids[i]))
            out += [ids[low:i], np.array([self.lattice.byte[b] for b in (SPACE if c == _OWN_MARK else c).encode()], np.int64)]
            low = i + 1
        return np.concatenate([*out, ids[low:]]).astype(np.int32)

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        out, pending = [], bytearray()
        byte_of = {i: b for b, i in enumerate(self.lattice.byte)}
        for i in ids.tolist():
            if i in byte_of:
                pending.append(byte_of[i])
            else:
                if pending:
                    out.append(pending.decode())
                    pending = bytearray()
                out.append(self.lattice.piece_text[i].replace(SPACE, " "))
        if pending:
            out.append(pending.decode())
        return "".join(out)[1:]


_SAMPLERS: dict[str, Sampler] = {}


def sampler(path: str) -> Sampler:
    if path not in _SAMPLERS:
        _SAMPLERS[path] = Sampler(path)
    return _SAMPLERS[path]


def _mapped(df: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    small_batches(df.sparkSession)
    key = F.xxhash64(F.col(id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path)
        for batch in batches:
            texts, keys = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            for low, high in steps(sizes, STEP_CHARS):
                found = own.encode(keys[low:high], texts[low:high])
                arrays, names = columns(own, texts[low:high], found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *arrays], [id_col, *names])

    return df.select(F.col(id_col), key, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, {schema}")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``pieces``, an array of piece ids."""
    def columns(own, texts, found):
        return [pa.array([None if x is None else x for x in found], pa.list_(pa.int32()))], ["pieces"]

    return _mapped(df, path, id_col, text_col, "pieces array<int>", columns)


def decode(df: DataFrame, path: str, pieces_col: str = "pieces", to: str = "text") -> DataFrame:
    """``df`` with the texts of its pieces."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path)
        for batch in batches:
            at = batch.schema.get_field_index(pieces_col)
            texts = [own.decode(None if x is None else np.array(x, np.int32)) for x in batch.column(at).to_pylist()]
            kept = [i for i, c in enumerate(batch.schema.names) if c != to]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], [*(batch.schema.names[i] for i in kept), to])

    fields = "".join(f"`{c}` {k}, " for c, k in df.dtypes if c != to)
    return df.mapInArrow(run, f"{fields}`{to}` string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, pieces_sha256 (of the ids as 4-byte little-endian integers) and decoded_equal."""
    def columns(own, texts, found):
        n = pa.array([None if x is None else len(x) for x in found], pa.int64())
        sha = pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string())
        same = pa.array([own.lattice.model.decode(x.tolist()) == t if t and t[0] != " " and SPACE not in t else own.decode(x) == t for t, x in zip(texts, found)])
        return [n, sha, same], ["n_pieces", "pieces_sha256", "decoded_equal"]

    return _mapped(df, path, id_col, text_col, "n_pieces long, pieces_sha256 string, decoded_equal boolean", columns)


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_piece_sampling": op3_piece_sampling}
ORACLES: dict[str, str] = {}
