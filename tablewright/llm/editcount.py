"""Token counts that follow edits, kept in a segment tree per document.

A text is cut into pre-tokens by the tokenizer's pattern; LEAF of them in a row
form a leaf with its characters and tokens.  A complete binary tree over the
leaves holds the sums of both.  An edit (position, characters removed, text
added) descends by characters to the leaves it touches, cuts the text anew from
the start of the last leaf that ends at least two characters before the edit
(no piece that ends earlier was decided by a character of the edit) until a new
piece ends at the border of an old leaf behind the edit, counts the tokens
of just those pieces, and updates the sums on the paths of the leaves concerned.  From
that border on the text is the same and the pattern has no memory, so the old
pieces hold.  A leaf that grew beyond WIDE pieces' worth is split by building the
tree anew from the leaves.

Positions are code points, clipped to the text; edits apply one after the other to the
text so far.  Null text counts as empty, null edits as none.  Equal rows give equal results.
"""

from __future__ import annotations

import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import read_ranks
from .common import staged
from .worker import Memo, each, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LEAF, WIDE = 16, 256
#: Bytes of a worker's memo of the token counts of pieces.
PIECES = 56 << 20
#: How far beyond its end the pattern can look before it settles a piece.
CONTEXT = 2
EDIT = "array<struct<at:int,removed:int,added:string>>"


class Counter:
    """Pieces of texts and their token counts."""

    def __init__(self, path: str, pattern: str):
        coder = tiktoken.Encoding("edit", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)
        # a piece cut alone is one piece again, so this is the count of that piece
        self.tokens = Memo(lambda piece: len(coder.encode_ordinary(piece)), PIECES)


class Tree:
    """Characters and tokens of a text's leaves with the sums above them (root at 1, leaves from ``size``)."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.size = chars, tokens, len(chars) // 2

    @classmethod
    def of_leaves(cls, chars, tokens) -> "Tree":
        size = 1
        while size < len(chars):
            size *= 2
        both = []
        for leaves in (chars, tokens):
            nodes = np.zeros(2 * size, np.int32)
            nodes[size:size + len(leaves)] = leaves
            low = size
            while low > 1:
                nodes[low // 2:low] = nodes[low:2 * low:2] + nodes[low + 1:2 * low:2]
                low //= 2
            both.append(nodes)
        return cls(*both)

    @classmethod
    def of_text(cls, text: str, counter: Counter) -> "Tree":
        pieces = counter.pattern.findall(text)
        if not pieces:
            return cls.of_leaves([0], [0])
        firsts = np.arange(0, len(pieces), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int32, len(pieces)), firsts)
        tokens = np.add.reduceat(np.fromiter(map(counter.tokens.__getitem__, pieces), np.int32, len(pieces)), firsts)
        return cls.of_leaves(chars, tokens)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple:
        """(leaf, its first character) of the last leaf that starts at or before ``place``, by descent."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.chars[2 * node])
            # empty leaves at the far end are never entered
            if place >= start + left and self.chars[2 * node + 1]:
                node, start = 2 * node + 1, start + left
            else:
                node = 2 * node
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Sets a leaf and updates the sums on its path."""
        node = leaf + self.size
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, at: int, removed: int, added: str, counter: Counter) -> tuple:
        """(tree, new text, characters counted anew)."""
        at = max(0, min(at, len(text)))
        end = max(at, min(at + removed, len(text)))
        after = text[:at] + added + text[end:]
        shift = len(after) - len(text)
        first, start = self.leaf_at(max(0, at - CONTEXT))
        last, border = first, start + int(self.chars[self.size + first])
        while border < end and last + 1 < self.size:  # the leaves that the edit touches
            last += 1
            border += int(self.chars[self.size + last])
        pieces, place = [], start
        for m in counter.pattern.finditer(after, start):
            pieces.append(m.group())
            place = m.end()
            while border + shift < place and last + 1 < self.size:
                last += 1
                border += int(self.chars[self.size + last])
            if place == border + shift and place >= end + shift:
                break
        lengths, counts = [len(p) for p in pieces], [counter.tokens[p] for p in pieces]
        room = last - first + 1
        share = max(1, -(-len(pieces) // room))
        if share > WIDE:  # too many pieces for these leaves: a new tree with more of them
            cut = range(0, len(pieces), LEAF)
            new = [[sum(v[i:i + LEAF]) for i in cut] for v in (lengths, counts)]
            old = (self.chars[self.size:], self.tokens[self.size:])
            return Tree.of_leaves(*[np.concatenate([o[:first], n, o[last + 1:]]) for o, n in zip(old, new)]), after, place - start
        for i in range(room):
            self.put(first + i, sum(lengths[i * share:(i + 1) * share]), sum(counts[i * share:(i + 1) * share]))
        return self, after, place - start


def _counter(path: str, pattern: str) -> Counter:
    return keep(("edit_counter", path, pattern), lambda: Counter(path, pattern))


def _lists(arrays: list) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


STATE = "struct<chars:array<int>,tokens:array<int>>"


def trees(text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The tree of each text: node sums of characters and of tokens."""
    def run(texts: pa.Array) -> pa.Array:
        counter = _counter(path, pattern)
        built = [Tree.of_text(t or "", counter) for t in each(texts)]
        return pa.StructArray.from_arrays([_lists([t.chars for t in built]), _lists([t.tokens for t in built])], ["chars", "tokens"])
    return F.arrow_udf(run, STATE)(F.col(text))


def build_state(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged state: key, text, tree."""
    return staged(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), trees(text).alias("tree")), "edit-state")


def apply_edits(state: DataFrame, edits: str = "edits", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Adds ``result`` (text, tree, n_tokens before, edited_tokens after, recounted characters) to rows of
    text, tree and an array of edits (at, removed, added)."""
    def run(texts: pa.Array, states: pa.Array, lists: pa.Array) -> pa.Array:
        counter = _counter(path, pattern)
        new, made, before, after, recounted = [], [], [], [], []
        chars, tokens = states.field("chars"), states.field("tokens")
        for i, (text, todo) in enumerate(zip(each(texts), each(lists))):
            tree = Tree(chars[i].values.to_numpy(zero_copy_only=False).copy(), tokens[i].values.to_numpy(zero_copy_only=False).copy())
            before.append(tree.total)
            seen = 0
            for e in todo or []:
                tree, text, n = tree.edit(text, e["at"] or 0, e["removed"] or 0, e["added"] or "", counter)
                seen += n
            new.append(text)
            made.append(tree)
            after.append(tree.total)
            recounted.append(seen)
        tree_column = pa.StructArray.from_arrays([_lists([t.chars for t in made]), _lists([t.tokens for t in made])], ["chars", "tokens"])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), tree_column, pa.array(before, pa.int64()), pa.array(after, pa.int64()),
                                           pa.array(recounted, pa.int64())], ["text", "tree", "n_tokens", "edited_tokens", "recounted"])
    kind = f"struct<text:string,tree:{STATE},n_tokens:bigint,edited_tokens:bigint,recounted:bigint>"
    return state.withColumn("result", F.arrow_udf(run, kind)("text", "tree", edits))


def sample_edits(key: str = "doc_id", text: str = "text", count: int = 3) -> Column:
    """``count`` edits per document derived from its id and text: at a hashed place some characters make room
    for a passage of the same text."""
    def one(i: int) -> Column:
        draw = lambda what, n: F.pmod(F.xxhash64(F.col(key), F.lit(f"{what}{i}")), n).cast("int")
        size = F.length(text)
        return F.struct(draw("at", size + 1).alias("at"), draw("cut", F.lit(25)).alias("removed"),
                        F.substr(F.col(text), draw("from", size + 1) + 1, draw("add", F.lit(40))).alias("added"))
    return F.array(*[one(i) for i in range(count)]).cast(EDIT)
