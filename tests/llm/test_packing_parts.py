"""Token ids where parts must reach the tokenizer as they stand."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from glyphmill.llm.packing import IdEncoder


def test_added_tokens_and_combining_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["<|ENDOFTEXT|> a", "<|StartOfText|>.", "<|endoftext|>", "İ.", "ALİ, İ", "Word, WORD.", "Don't. A.B, 7."]
    ids, bounds = IdEncoder(path).encode(pa.array(texts))
    exact = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == exact
