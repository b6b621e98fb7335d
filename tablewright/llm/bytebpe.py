"""Byte-level BPE by longest matches with backtracking, and decoding.

The vocabulary is a rank file (token bytes in base64 and rank, one pair per
line).  A text is cut into pieces by the tokenizer's pattern, and each piece is
encoded alone.  Two neighbouring tokens are compatible when merging their
joined bytes gives the same two tokens back; a sequence of tokens is what the
merges would give exactly when all its neighbours are compatible.  So a piece
is encoded without merging it: its bytes, read as Latin-1 characters, run
through an Aho-Corasick automaton of all tokens, which tells the longest token that
starts at a position; from the left the longest one compatible with its
predecessor is taken, shorter ones (each token knows the longest that begins it) after dead ends.  Positions
proved dead are marked and never entered again, which makes the search linear.

Compatibility is memoised per pair of tokens.  It follows from the two merge
trees: a part on the right edge of the first token and one on the left edge of
the second would have merged across the border if their joined bytes are a
token that comes before either part is merged into its own parent.

Repeated words make up most of a text: the distinct space-separated chunks of some megabytes of text are cut into
pieces once, ids are memoised per piece (in a memo of bounded bytes), and put together by array operations.  Chunks are used where every space
stands alone between two visible characters: a piece then always ends before the
space.  Texts with other spacing are cut by the pattern as a whole.

Null text counts as empty; empty text has no ids and decodes to no bytes.
Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import Memo, each, gathered, keep, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of the memos of a worker process.
PIECES, PAIRS = 48 << 20, 16 << 20
#: Bytes of text that are encoded at a time.
TEXTS = 4 << 20
NEVER = 1 << 60


def read_ranks(path: str) -> dict:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_tree(data: bytes, ranks: dict) -> list:
    """What the merges leave of ``data``: nodes (bytes, left node, right node)."""
    parts = [(data[i:i + 1], None, None) for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i][0] + parts[i + 1][0], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[i:i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1])]
    return parts


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.table = {i: b for b, i in self.ranks.items()}
        self.pieces_of = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        self.left, self.right = {}, {}
        for data, rank in self.ranks.items():
            tree = merge_tree(data, self.ranks)
            if len(tree) == 1:  # tokens that no merge makes only stand for whole pieces
                self.automaton.add_word(data.decode("latin-1"), (len(data) - 1, rank))
                self.left[rank], self.right[rank] = self.edge(tree[0], 1), self.edge(tree[0], 2)
        self.automaton.make_automaton()
        # the longest token that begins a token, -1 for none
        able = {data: rank for data, rank in self.ranks.items() if rank in self.left}
        self.lengths = {rank: len(data) for data, rank in able.items()}
        self.shorter = {rank: next((able[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in able), -1) for data, rank in able.items()}
        self.pair = Memo(self.compatible, PAIRS)
        self.piece = Memo(self.encode_piece, PIECES)
        self.tokens = pa.array([self.table.get(i, b"") for i in range(max(self.table) + 1)], pa.large_binary())
        self.packed = {i: i.to_bytes(4, "little") for i in self.table}

    def edge(self, node: tuple, side: int) -> list:
        """(bytes, when it comes to be, when it is merged) of the parts along one edge of a token, largest first."""
        out, end = [], NEVER
        while node:
            born = self.ranks[node[0]] if node[1] else -1
            out.append((node[0], born, end))
            node, end = node[side], born
        return out

    def compatible(self, pair: int) -> bool:
        """Of two neighbours, packed as first << 20 | second."""
        first, second = pair >> 20, pair & 0xFFFFF
        for a, a_born, a_end in self.right[first]:
            for b, b_born, b_end in self.left[second]:
                rank = self.ranks.get(a + b)
                if rank is not None:
                    when = max(rank, a_born, b_born)
                    # of equal ranks the one further left merges first
                    if when < a_end and when <= b_end:
                        return False
        return True

    def encode_piece(self, text: str) -> bytes:
        """Longest match first; after a dead end the next shorter token at the place before."""
        data = text.encode("utf-8", "surrogatepass")
        if data in self.ranks:
            return self.packed[self.ranks[data]]
        pair, shorter, lengths, size, latin = self.pair, self.shorter, self.lengths, len(data), data.decode("latin-1")
        first = {end - before: token for end, (before, token) in self.automaton.iter_long(latin)}
        dead, path, at, last, token = bytearray(size + 1), [], 0, -1, first[0]
        while True:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (last < 0 or pair[last << 20 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == size:
                    return b"".join([self.packed[t] for t in path])
                at, last = end, token
                token = first[at] if at in first else next(self.automaton.iter_long(latin, at))[1][1]
            else:
                dead[at] = 1
                token = path.pop()  # some sequence always fits: single bytes are tokens
                at, last, token = at - lengths[token], path[-1] if path else -1, shorter[token]

    def encode_part(self, text: str) -> bytes:
        return b"".join([self.piece[p] for p in self.pieces_of(text)])

    def encode_chunks(self, chunks: list) -> tuple:
        """(ids, ends) of chunks, each taken with a space before it.  They are cut into pieces as one text: a piece
        that begins with a space begins a chunk."""
        pieces = self.pieces_of(" " + " ".join(chunks)) if chunks else []
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        ids, ends = gathered(self.piece.many(names, lambda new: {p: self.encode_piece(p) for p in new}), coded.indices.to_numpy())
        opens = np.flatnonzero(np.array([p[0] == " " for p in names], bool)[coded.indices.to_numpy()])
        if len(opens) != len(chunks):  # a pattern that parts the space from what follows
            return gathered([self.encode_part(" " + c) for c in chunks], np.arange(len(chunks)))
        return ids, np.r_[0, ends][np.r_[opens[1:], len(pieces)]] if pieces else ends

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text]))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple:
        """(ids, ends): the ids of all texts one after the other, and where those of each text end."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        counts = parts.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        first, last, of = np.zeros(len(codes), bool), np.zeros(len(codes), bool), np.repeat(np.arange(len(texts)), counts)
        first[ends - counts], last[ends - 1] = True, True
        # a space next to white space or to an end of the text: the whole text is cut by the pattern
        opens = np.array([not c or c[0].isspace() for c in chunks], bool)
        closes = np.array([not c or c[-1].isspace() for c in chunks], bool)
        odd = np.zeros(len(texts), bool)
        odd[of[(opens[codes] & ~first) | (closes[codes] & ~last)]] = True
        inner = ~first & ~odd[of]
        used = np.flatnonzero(np.bincount(codes[inner & ~closes[codes]], minlength=len(chunks)))
        ids, at = self.encode_chunks([chunks[i] for i in used.tolist()])
        # what stands alone: first chunks, which have no space before them, last ones that end in white space, and odd texts
        alone: list = []
        place = np.full(len(chunks), -1)
        place[used] = np.arange(len(used))
        where = place[codes]
        for flags, lead in ((first & ~odd[of], ""), (inner & closes[codes], " ")):
            some, inverse = np.unique(codes[flags], return_inverse=True)
            where[flags] = len(used) + len(alone) + inverse
            alone += [self.encode_part(lead + chunks[i]) for i in some.tolist()]
        if odd.any():
            kept, whole = ~odd[of], np.flatnonzero(odd)
            of, where = np.r_[of[kept], whole], np.r_[where[kept], len(used) + len(alone) + np.arange(len(whole))]
            alone += [self.encode_part(texts[i].as_py()) for i in whole.tolist()]
            order = np.argsort(of, kind="stable")
            of, where = of[order], where[order]
            ends = np.cumsum(np.bincount(of, minlength=len(texts)))
        sizes = np.r_[np.diff(np.r_[0, at]), [len(x) // 4 for x in alone]].astype(np.int64)
        every = np.r_[ids, np.frombuffer(b"".join(alone), "<u4")]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(every))
        return lists.take(pa.array(where)).flatten().to_numpy(), np.r_[0, np.cumsum(sizes[where])][ends]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list:
        """The bytes of each run of ids, as views of one buffer."""
        tokens = self.tokens.take(pa.array(ids.astype(np.int64)))
        places = np.frombuffer(tokens.buffers()[1], np.int64)[:len(ids) + 1][np.r_[0, ends]].tolist()
        data = memoryview(tokens.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(places, places[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str = VOCABULARY, pattern: str = PATTERN) -> ByteBpe:
    return keep(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_ids(text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The ids of the whole text as an array of integers."""
    def run(texts: pa.Array) -> pa.Array:
        c, parts, sizes = coder(path, pattern), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for some in slices(texts, TEXTS):
            ids, ends = c.encode_all(some)
            parts.append(ids)
            sizes.append(np.diff(np.r_[0, ends]))
        at = np.cumsum(np.r_[0, np.concatenate(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32)))
    return F.arrow_udf(run, "array<int>")(F.col(text))


def decode_ids(ids: str = "ids", path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The bytes that an array of ids stands for; null ids give null."""
    def run(rows: pa.Array) -> pa.Array:
        c = coder(path, pattern)
        return pa.array([None if r is None else c.decode(np.array(r, "<u4").tobytes()) for r in each(rows)], pa.binary())
    return F.arrow_udf(run, "binary")(F.col(ids))


def round_trip(text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN, with_ids: bool = False) -> Column:
    """Struct of n_tokens, ids_sha256, decoded_sha256 (and the ids): encodes, then decodes the ids."""
    def run(texts: pa.Array) -> pa.Array:
        c, parts, sizes, digests, decoded = coder(path, pattern), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], []
        for some in slices(texts, TEXTS):
            ids, ends = c.encode_all(some)
            data = memoryview(ids.astype("<u4").tobytes())
            digests += [hashlib.sha256(data[4 * a:4 * b]).hexdigest() for a, b in zip(np.r_[0, ends].tolist(), ends.tolist())]
            decoded += [hashlib.sha256(d).hexdigest() for d in c.decode_all(ids, ends)]
            sizes.append(np.diff(np.r_[0, ends]))
            if with_ids:
                parts.append(ids.astype(np.int32))
        sizes = np.concatenate(sizes)
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, sizes]).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32))))
            names.append("ids")
        return pa.StructArray.from_arrays(columns, names)
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if with_ids else ">")
    return F.arrow_udf(run, kind)(F.col(text))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and (``with_ids``) ids, one row per input row."""
    out = docs.select(F.col(key).alias("__key"), round_trip(text, with_ids=with_ids).alias("__t"))
    return out.select(F.col("__key").alias(key), "__t.*")
