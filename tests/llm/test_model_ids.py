import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from sparkpipe.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_are_the_librarys(spark):
    """Every whole document of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = [(-1, "The quick brown fox jumps over the lazy dog."), (-2, "  two \n日本 "), (-3, "a ▁ b")]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in sentencepieces.encode_pieces(docs, PATH).collect()}
    known, sp = sentencepieces.lattice(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(got[-1]) == 12
    assert [i for i, t in texts.items() if got[i] != sp.encode(t)] == [-3]  # a text with a space mark of its own
    assert all(known.decode(got[i]) == t for i, t in texts.items())


def test_random_texts():
    known, sp, dice = sentencepieces.lattice(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(5)
    letters = ["a", "b", "e", "th", " ", "  ", "é", "日", "\n", "\t", "\x00", "\x7f", "🙂", ".", "▁"]
    for _ in range(1500):
        text = "".join(dice.choice(letters) for _ in range(dice.randint(0, 60)))
        ids = np.frombuffer(known.encode(text, 2)[0], "<i4").tolist()
        assert known.decode(ids) == text
        assert "▁" in text or ids == sp.encode(text)
