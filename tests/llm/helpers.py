"""Small inputs for the operators of tickweave.llm."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

#: null, empty and blank texts, special tokens, contractions, other scripts, control characters, a text over many windows
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "Don't they'll 'tis we've", "x<|endoftext|>y <|startoftext|>", "<| pipe |>", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ﬁ é é",
    "漢字かな交じり文。", "tab\tand nbsp em\x1cfs\x85nel", "ünï-cödé!! (a,b) 3.14 100%", "🙂🙂 ok…", "word " * 9000, "aaaa" * 700, "a\r\nb\vc\fd", "\x00nul",
]


def encode(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def documents(spark, texts, ids=None, **extra):
    """A table like `documents`, with columns whose names the operators use inside."""
    rows = [
        (i, t, "en", "src0", len(t or ""), -1, "x", True, b"")
        for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, part int, score string, kept boolean, ids binary"
    )
