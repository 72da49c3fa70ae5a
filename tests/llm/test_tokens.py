import random

import pytest

from vellumine.llm.queries import BYTE_TOKENS, WORD_TOKENS, vocabulary
from vellumine.llm.tokens import Encoder


@pytest.mark.parametrize("name", [WORD_TOKENS, BYTE_TOKENS])
def test_same_as_whole_texts(name):
    from tokenizers import Tokenizer

    g = random.Random(1)
    parts = [" ", "\n", "a", "B", "'s", "é", " ", "\t", "1", ".", "́", "\x0b", "\x1c", "　", " ", "'", "中", "\r\n", "  ", "\x85", "İ", "Σ", "The", "thé", ",", ".,", " Is. "]
    texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 30))) for _ in range(9000)]
    want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(vocabulary(name)).encode(texts)] == want
