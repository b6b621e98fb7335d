"""Work of op1's word encoder."""

import numpy as np
import pyarrow as pa

from tablewright.llm import tokenfile as T
from tablewright.llm.worker import slices


def test_text_of_one_file_is_looked_up_at_once():
    assert len(list(slices(pa.array(["word " * 400] * T.ROWS_PER_FILE), T.TEXTS))) == 1


def test_learned_words_have_the_ids_of_single_calls():
    encoder = T.WordEncoder(T.VOCABULARY)
    words = ["house", "house.", "tree.", "x7,", ".", "a:", "<|endoftext|>", "naïve", "3.5"]
    assert encoder.known.many(words, encoder.learn) == [np.array(encoder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
