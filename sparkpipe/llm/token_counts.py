"""Token counts through a digest cache (operator 3)."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import arrow_rows, bounded, new_path

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Words whose counts a worker remembers before it starts anew.
WORD_CACHE = 200_000
#: The pre-tokens of the byte-level family over Latin-1, with its classes written out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PRETOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class WordCounter:
    """Counts as the library's encode gives them.

    Merges stay within a pre-token, so the count of a text is the sum over its pre-tokens, and most of these repeat.
    Texts with letters beyond Latin-1 or with a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        plain = self.library.normalizer is None and "ByteLevel(add_prefix_space=False" in str(self.library.pre_tokenizer) and "use_regex=True" in str(self.library.pre_tokenizer)
        self.by_word = plain and "Sequence" not in str(self.library.pre_tokenizer)
        self.words: dict[str, int] = {}

    def _whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        found = _PRETOKEN.findall(text)
        try:
            return sum(map(self.words.__getitem__, found))
        except KeyError:
            pass
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        new = list({w for w in found if w not in self.words})
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.words.update(zip(part, (len(e.ids) for e in self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return sum(map(self.words.__getitem__, found))


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """One counter a worker process and tokenizer."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, so that a changed tokenizer never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts; a folder that does not exist yet has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, cache_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = 512
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of docs.

    The normal form of a content is its text, null as empty: anything coarser changes counts.  Its SHA-256 and the
    tokenizer's version are joined to the counts in cache_dir; of what is missing each distinct text is encoded once and
    its count appended there, then the counts are read back.  Without a cache_dir a new one in the shared folder serves
    this call.  Against a cache with counts, digests alone are joined first, and only texts that miss travel on.  Copies
    are merged before the shuffle, so a text that many rows share travels once a task.  Two jobs that fill one cache at
    once may append a digest twice, with one count.

    Repeated rows and ids stay as they are.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    cache_dir = cache_dir or new_path(spark, "token-cache")
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = read_cache(spark, cache_dir).where(F.col("version") == version).select("digest")
    texts = keyed.select("digest", "text")
    if not known.isEmpty():
        missing = keyed.select("digest").distinct().join(known, "digest", "left_anti")
        texts = texts.join(bounded(missing, "missing"), "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in batches:
            n = [c.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), batch.column(0), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"])

    arrow_rows(misses, run, CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.concat("digest", F.lit(b"\0")).alias("k"))
    return (
        rows.join(counts.select(F.concat("digest", F.lit(b"\0")).alias("k"), "n_tokens"), "k")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
    )
