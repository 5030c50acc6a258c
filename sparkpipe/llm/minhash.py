"""MinHash near-duplicates with sequential Bayesian verification (operator 4)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_rows, bounded, connected_components, splittable, stored, without_rows
from .wordhash import shingle_set

#: Rows in a band, and bands: at a similarity of 0.8 they miss a pair with probability 5e-7.
ROWS, BANDS = 6, 48
N_HASHES = ROWS * BANDS
#: Members verified against one copy of their hub's set.
HUB_CHUNK = 64
#: Counters of the sketch that orders shingles by frequency, whatever the input's size.
SKETCH = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """uint16 parts of N_HASHES minima over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(N_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        p = x[i : i + 2048]
        for j in range(0, N_HASHES, 32):
            t = np.multiply.outer(_A[j : j + 32], p)
            t += _B[j : j + 32, None]
            np.minimum(low[j : j + 32], t.min(axis=1), out=low[j : j + 32])
    return low.astype("<u2")


def fewest_matches(threshold: float, miss: float, batch: int) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches that keep a pair): below, P(similarity >= threshold | matches) < miss.

    The prior is uniform, so after m matches of n the posterior is Beta(m + 1, n - m + 1), and its upper tail is the
    chance of at most m successes in n + 1 draws at the threshold.
    """
    out = []
    for n in range(batch, N_HASHES + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _text_bytes(column: pa.Array) -> Iterator[bytes]:
    for v in column:
        yield v.as_buffer().to_pybytes() if v.is_valid else b""


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for t in _text_bytes(batch.column(2)):
                s = shingle_set(t, k)
                n.append(len(s))
                key.append(_key(s) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "content", "n_shingles", "set_key", "sig"]
            )

    return arrow_rows(docs.select("doc_id", "content", "text"), run, "doc_id long, content long, n_shingles long, set_key binary, sig binary")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(cid, shingles): the full sets of the classes in ids, made anew from one text each."""
    wanted = classes.join(ids, "cid", "left_semi").select("cid", "set_key", F.col("at.doc_id").alias("at_id"), F.col("at.content").alias("at_content"))
    wanted = bounded(wanted, "wanted")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("content") == F.col("at_content"))).select("cid", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, sets = [], []
            for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _text_bytes(batch.column(2)), strict=True):
                s = shingle_set(text, k)
                if _key(s) == key:  # else another text of one id and hash
                    cid.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return stored(arrow_rows(texts, run, "cid long, shingles binary").dropDuplicates(["cid"]), "sets")


def _buckets(classes: DataFrame) -> DataFrame:
    """(band, cid, hub, n): the members of the bands' buckets that have two at least; a bucket's smallest is its hub."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    banded = classes.select("cid", F.explode(keys).alias("band"))
    hubs = banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return banded.select(splittable("band").alias("band"), "cid").join(hubs.select(splittable("band").alias("band"), "hub", "n"), "band")


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float, batch_size: int) -> DataFrame:
    """The pairs whose signatures leave a chance of at least `miss` for the threshold, batch after batch."""
    steps = fewest_matches(threshold, miss, batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(v.as_py() for v in part.column(i)), "<u2").reshape(-1, N_HASHES) for i in (2, 3))
                alive, same, seen = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
                for n, fewest in steps:
                    same = same + (x[alive, seen:n] == y[alive, seen:n]).sum(axis=1)
                    stay = same >= fewest
                    alive, same, seen = alive[stay], same[stay], n
                    if not len(alive):
                        break
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(alive)), part.column(1).take(pa.array(alive))], ["a", "b"])

    sig = classes.select("cid", "sig", "n_shingles")
    few, many = F.least("na", "nb"), F.greatest("na", "nb")
    joined = (
        pairs.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
        .join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a")
        .where(few >= many * F.lit(threshold - 1e-9))
    )
    return arrow_rows(joined.select("a", "b", "sa", "sb"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs with 100 * common >= percent * union on the full sets.

    A hub's set goes once to each HUB_CHUNK of its members; a task holds one hub's set and one member's at a time.
    """
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / HUB_CHUNK).cast("int"))
    chunk = F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")
    members = pairs.join(sized.select(splittable("a").alias("k"), "chunks"), splittable("a") == F.col("k")).select("a", chunk.alias("chunk"), "b")
    placed = (
        sized.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("a", "chunk", F.lit(0).alias("kind"), F.col("a").alias("cid"))
        .union(members.select("a", "chunk", F.lit(1), "b"))
    )
    rows = (
        sets.select(splittable("cid").alias("k"), "shingles").join(placed, splittable("cid") == F.col("k"))
        .repartition(F.col("a"), F.col("chunk"))
        .sortWithinPartitions("a", "chunk", "kind", "cid")
        .select("a", "chunk", "kind", "cid", "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for batch in batches:
            a, chunk, kind, cid = (batch.column(i).to_pylist() for i in range(4))
            left, right = [], []
            for i, v in enumerate(batch.column(4)):
                s = np.frombuffer(v.as_buffer(), "<u8")
                if not kind[i]:
                    group, hub = (a[i], chunk[i]), s.copy()
                elif group == (a[i], chunk[i]):
                    common = len(s) + len(hub) - len(np.union1d(s, hub))
                    if 100 * common >= percent * (len(s) + len(hub) - common):
                        left.append(a[i])
                        right.append(cid[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return arrow_rows(rows, run, "u long, v long")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, label): members of buckets that the links with their hubs leave in several components."""
    known = buckets.where("n > 2").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("band", "cid", F.coalesce("label", "cid").alias("label"))
    known = stored(known, "known")
    mixed = known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return known.select(splittable("band").alias("k"), "cid", "label").join(mixed.select(splittable("band").alias("k")), "k", "left_semi").select("cid", "label").distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """SKETCH counters of shingles by the low bits of their hash: never less than the shingle's frequency among the sets."""
    block = 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for v in batch.column(0):
                np.add.at(total, (np.frombuffer(v.as_buffer(), "<u8") & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        yield from _blocks({i: total[i * block : (i + 1) * block] for i in range(SKETCH // block)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(v.as_buffer()), "<i8")
        yield from _blocks(sums)

    parts = arrow_rows(sets.select("shingles"), count, "block int, counts binary")
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in arrow_rows(parts.repartition("block"), add, "block int, counts binary").collect():  # SKETCH numbers, whatever the input's size
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _blocks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of counters, compressed: a partition of few sets has mostly zeros."""
    some = [(i, v) for i, v in sums.items() if v.any()]
    for lo in range(0, len(some), 64):
        part = some[lo : lo + 64]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), pa.array([zlib.compress(v.astype("<i8").tobytes(), 1) for _, v in part], pa.binary())], ["block", "counts"])


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's rarest elements meet one of a linked set's: as the smaller set of the two, and as the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefixes(sets: DataFrame, frequency: np.ndarray, percent: int) -> DataFrame:
    """(token, cid, n, pos, small): each set's rarest shingles; small tells whether they serve it as the smaller set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "cid", "n", "pos", "small"]
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for cid, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(v.as_buffer(), "<u8")
                often = frequency[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                few, more = prefix_lengths(len(s), percent)
                pos = np.arange(more)
                at = np.lexsort((s, often))[:more]
                met = often[at] > 1  # the others are in no other set
                for c, x in zip(cols, (s[at].view("<i8"), np.full(more, cid), np.full(more, len(s)), pos, pos < few), strict=True):
                    c.append(x[met])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else []).cast(t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.bool_(),), strict=True)], names)

    return arrow_rows(sets.select("cid", "shingles"), run, "token long, cid long, n long, pos long, small boolean")


def _prefix_pairs(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different components that share a rare shingle, where the places leave room for enough others.

    Of a shingle's sets most are often of one component; those of others are joined with all, the former with these
    alone, so that a large component is not held against itself.
    """
    rows = prefixes.join(labels, "cid")
    by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = stored(
        rows.select(splittable("token").alias("k"), "cid", "n", "pos", "small", "label").join(most.select(splittable("token").alias("k"), "main"), "k")
        .withColumn("minor", F.col("label") != F.col("main")).drop("main"),
        "prefixes",
    )
    few = rows.where("small").select("k", *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "pos", "label", "minor")])
    all_ = rows.select("k", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "pos", "label", "minor")])
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # the shared shingle and those after it
    fits = (
        (F.col("label_a") != F.col("label_b")) & (F.struct("n_a", "cid_a") < F.struct("n_b", "cid_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
        & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b")))
    )
    found = None
    for a, b in ((few.where("minor_a"), all_), (few.where("NOT minor_a"), all_.where("minor_b"))):
        p = a.join(b, (a["k"] == b["k"]) & fits).select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b"))
        found = p if found is None else found.union(p)
    return found.distinct()


def document_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, miss: float = 1e-7, batch: int = 32
) -> DataFrame:
    """(doc_id, content, n_shingles, component_id, first_content): near_duplicates' rows, with the hash of the row's text
    and the least one among the component's rows of the id component_id."""
    percent = round(threshold * 100)
    if percent < 80 or abs(threshold * 100 - percent) > 1e-9:
        raise ValueError("threshold must be a whole number of hundredths, 0.80 at least")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"), F.col(f"`{text_col}`").alias("text"))
    base = stored(_signatures(docs, shingle_words), "signatures")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    classes = stored(
        base.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(least).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )

    def tested(pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
        pairs = stored(_pruned(pairs, classes, threshold, miss, batch), "survivors")
        if sets is None:
            ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
            sets = _sets(docs, classes, ids, shingle_words)
        return stored(_verified(pairs, sets, percent), "links")

    buckets = stored(_buckets(classes), "buckets")
    links = tested(buckets.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), None)
    labels = stored(connected_components(links), "labels")
    mixed = stored(_mixed(buckets, labels), "mixed")
    if not mixed.isEmpty():
        sets = _sets(docs, classes, mixed, shingle_words)
        pairs = _prefix_pairs(_prefixes(sets, _frequencies(sets), percent), mixed, percent)
        own = labels.union(mixed.join(labels, F.col("cid") == F.col("node"), "left_anti").select("cid", "label"))
        more = tested(pairs, sets).join(own.toDF("u", "lu"), "u").join(own.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        merged = stored(connected_components(more), "merged")
        labels = own.join(merged.toDF("label", "now"), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    labelled = classes.select("cid", "set_key", "at").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "at", F.coalesce("label", "cid").alias("label"))
    labelled = stored(labelled, "labelled")
    first = labelled.groupBy("label").agg(F.min("at").alias("first"))
    named = stored(
        labelled.select("set_key", splittable("label").alias("k")).join(first.select(splittable("label").alias("k"), "first"), "k")
        .select("set_key", F.col("first.doc_id").alias("component_id"), F.col("first.content").alias("first_content")),
        "named",
    )
    return base.select("doc_id", "content", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "content", "n_shingles", "component_id", "first_content", "set_key")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, miss: float = 1e-7, batch: int = 32
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked by Jaccard similarity of word shingles.

    Words lie between ASCII white space, A-Z count as a-z.  Equal sets form classes, of which one document's text stands
    for all.  Classes whose signatures agree in a band share a bucket, and a bucket's members are held against its
    smallest.  Where that leaves several components in a bucket, its members are dealt anew by their rarest shingles:
    linked sets share one of these, so the pairs across components that share one are all that can be linked, whatever
    the buckets' sizes.  All candidates are compared signature batch by signature batch and dropped once the posterior
    chance of reaching the threshold is under `miss`; survivors are verified on their full sets, whose members are
    64-bit hashes of whole shingles.

    Null and empty texts have no shingles and link with nothing; texts shorter than a shingle are one shingle.  A
    row without an id has the smallest id that it is linked with, null if there is none, and counts as kept then.  Rows
    repeated with one id and text get equal results, one row each; rows of one id and other texts their own.  An empty table gives an empty result.  Other columns are not read.
    The threshold must be at least 0.8, a whole number of hundredths; bands are laid out for it.
    """
    out = document_classes(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, threshold=threshold, miss=miss, batch=batch)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the smallest (id, content hash), rows without an id last.

    Rows without shingles (null and empty texts) all stay, even where they repeat.  Of rows that repeat with one id and
    text one stays.  Columns pass through.  An empty table gives an empty result.
    """
    classes = stored(document_classes(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, threshold=threshold), "document_classes")
    stays = F.col("set_key").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("content") == F.col("first_content"))
    some = classes.where("set_key IS NOT NULL")
    left = without_rows(docs, classes.where(~stays), id_col, text_col)
    if some.where(stays).groupBy("doc_id", "content").count().where("count > 1").isEmpty():
        return left
    words = F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(words).dropDuplicates([id_col, text_col]).unionByName(left.where(~words))


#: DuckDB SQL for the 2-word query over the table documents.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN [w[1]] ELSE CAST([] AS VARCHAR[]) END AS s FROM words
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM sets
), items AS (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), rare AS (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM items)
), prefix AS (
  SELECT doc_id, n, g FROM rare WHERE k <= n - ceil(0.8 * n) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT x, y FROM (SELECT x, y, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS t FROM cand JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y) WHERE 100 * i >= 80 * (t - i)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sized s JOIN comp c ON s.doc_id = c.doc_id
"""
