"""Token ids in ORC files with row indexes and Bloom filters on the document id.

Every whole text is encoded with a vocabulary of the tokenizers library and gets
an end id.  Documents are sorted by id over all files (range partitions), one row
per document: its id, its place in the order, its ids as an integer list.  ORC
stores integers run-length encoded in stripes; each stripe carries minima, maxima
and a Bloom filter of the document ids for every ``STRIDE`` rows.  So stripes are
read in parallel, and a look-up by document id skips files, stripes and row groups
by metadata.

Encoding.  The vocabulary's cleaning and splitting never reach across ASCII white
space, so a text's ids are those of its words in order.  It lower-cases letters and takes a single punctuation mark
between an ASCII letter or digit and white space as a part of its own, so words are put in lower case and a word that ends
in such a mark is taken apart.  Words repeat: the distinct words of some megabytes of text are looked up once, in a memo of bounded
bytes where frequent words last; those it lacks are encoded many by one call, words of letters side by side (their last tokens tell them
apart), others parted by a special token; ids are then put together by array operations.

Null text counts as empty: it has the end id alone.  Null ids sort last.  Rows
with equal ids are ordered by text hash; repeated rows all stay.  An empty table
gives files without rows.
"""

from __future__ import annotations

import itertools
import os
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .worker import Memo, gathered, keep, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 2
#: Bytes of a worker's memo, words encoded by one call, and bytes of text split at a time.
WORDS, BATCH, TEXTS = 96 << 20, 4_000, 12 << 20
#: Marks that part from the word before them, and what may stand before them.
MARKS, BEFORE = frozenset(".,;:!?|"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: A special token, which parts words that are encoded by one call.
FENCE = "<|startoftext|>"
#: How the vocabulary marks a token that ends a part of a word.
LAST = "</w>"
#: Rows between entries of the row index, and bytes of a stripe.
STRIDE, STRIPE = 1_000, 16 << 20
LOCAL_BITS = 33
#: Documents of one file, which is also what one task of ``catalog`` holds.
ROWS_PER_FILE = 5_000


class WordEncoder:
    """Ids of texts by way of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fence, self.known = self.tokenizer.token_to_id(FENCE), Memo(self.alone, WORDS)
        # tokens that end a part of a word
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(LAST)]] = True

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, words: list, between: str) -> dict:
        """Ids of words by one call, cut behind the tokens that end a part (``between`` is a space: words of letters alone,
        which are one part each) or at the fence; nothing if the cuts don't come to one per word."""
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, "<u4")
        if between == " ":
            ends = np.flatnonzero(self.last[ids]) + 1
            starts = np.r_[0, ends[:-1]]
        else:
            ends = np.r_[np.flatnonzero(ids == self.fence), len(ids)]
            starts = np.r_[0, ends[:-1] + 1]
        data, whole = ids.tobytes(), len(ends) == len(words) and ends[-1] == len(ids)
        return {w: data[4 * i:4 * j] for w, i, j in zip(words, starts.tolist(), ends.tolist())} if whole else {}

    def learn(self, words: list) -> dict:
        """Ids of distinct words that the memo does not hold."""
        parted = {w: (w[:-1], w[-1]) for w in words if len(w) > 1 and w[-1] in MARKS and w[-2] in BEFORE}
        plain = dict.fromkeys(w for w in words if w not in parted) if parted else words
        held, older = self.known.get, self.known.older.get
        # whole words are known to be missing; only what parted words consist of may be held
        out = {x: held(x) or older(x) for x in set(itertools.chain.from_iterable(parted.values())).difference(plain)}
        letters, others, odd = [], [], []
        for w in itertools.chain(plain, [x for x, ids in out.items() if ids is None]):
            (letters if w.isalpha() else odd if "<|" in w else others).append(w)
        for group, between in ((letters, " "), (others, FENCE)):
            for at in range(0, len(group), BATCH):
                part = group[at:at + BATCH]
                done = self.together(part, between)
                out |= done or {w: self.alone(w) for w in part}
        out |= {w: self.alone(w) for w in odd}
        found = {w: out[w] for w in plain}
        found.update((w, out[a] + out[b]) for w, (a, b) in parted.items())
        return found

    def encode(self, texts: list) -> list:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(np.r_[0, ends], ends)]

    def encode_all(self, texts: pa.Array) -> tuple:
        """(ids, ends): the ids of all texts one after the other, and where those of each text end."""
        texts = pc.fill_null(texts, "")
        # special tokens are told by their case, so texts that may hold one keep theirs
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        ids, ends = gathered(self.known.many(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.learn), coded.indices.to_numpy())
        per_text = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return ids, np.r_[0, ends][per_text]


def token_ids(text: str = "text", path: str = VOCABULARY, end: int = END) -> Column:
    """Array of the text's ids and the end id."""
    def run(texts: pa.Array) -> pa.Array:
        encoder = keep(("word_encoder", path), lambda: WordEncoder(path))
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for some in slices(texts, TEXTS):
            ids, ends = encoder.encode_all(some)
            parts.append(np.insert(ids, ends, end))
            sizes.append(np.diff(np.r_[0, ends]) + 1)
        at = np.cumsum(np.r_[0, np.concatenate(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32)))
    return F.arrow_udf(run, "array<int>")(F.col(text))


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 end: int = END) -> None:
    """Writes ORC files of (doc_id, place, n_tokens, ids) in ascending id order over the files.

    ``place`` orders all rows: partition number in the high bits, row in the
    partition in the low ``LOCAL_BITS`` bits.  Texts are sorted first and
    encoded where they are written, so each is encoded once.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    files = max(1, -(-docs.count() // ROWS_PER_FILE))  # ranges can't be split later, so their number grows with the input
    ordered = texts.repartitionByRange(files, *order).sortWithinPartitions(*order)
    coded = ordered.select("doc_id", F.monotonically_increasing_id().alias("place"), token_ids("text", vocabulary, end).alias("ids"))
    stored = coded.select("doc_id", "place", F.size("ids").cast("long").alias("n_tokens"), "ids")
    stored.write.options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
                            "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE), "compression": "zstd"}).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, found by the files' indexes and Bloom filters."""
    rows = spark.read.schema("doc_id bigint, place bigint, n_tokens bigint, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def ids_crc32(ids: str = "ids") -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    def run(rows: pa.Array) -> pa.Array:
        values, ends = rows.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.cumsum(np.r_[0, rows.value_lengths().to_numpy(zero_copy_only=False)])
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())
    return F.arrow_udf(run, "bigint")(F.col(ids))


def catalog(rows: DataFrame) -> DataFrame:
    """Per stored row: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Token counts are added up per partition of the order (one row each), the
    sums accumulated, and positions inside a partition found by a window; only
    partitions, never all rows, meet in one task.
    """
    each = rows.select("doc_id", "place", F.shiftright("place", LOCAL_BITS).alias("part"), F.size("ids").cast("long").alias("n_tokens"),
                       ids_crc32("ids").alias("ids_crc32"))
    sums = rows.groupBy(F.shiftright("place", LOCAL_BITS).alias("of")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = each.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(base, F.col("part") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")
