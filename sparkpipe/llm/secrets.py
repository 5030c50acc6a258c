"""Secret scans with corpus-wide ownership frequency (operator 10)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_rows, splittable, stored

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the base kinds.  hex runs and access keys are matched at once in the length that counts; a run that
#: is too short has no part that is long enough, so this drops the same matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the method adds: private key headers and web tokens.
EXTRA = (("private", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")), ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")))
MIN_ASSIGNED = 6
#: A value with this many owners is a widely copied example, and so is one with two owners and this many repositories;
#: one owner's value is that owner's, in however many repositories.
WIDE_OWNERS, WIDE_REPOS = 3, 6
#: What stands in for a credential, in lower case (fixed values).
PLACEHOLDERS = "example sample dummy changeme placeholder your test xxxx 1234 abcd".split()
#: Bits a letter from which on a value looks random.
MIN_ENTROPY = 2.9


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, secret) in order."""
    out = [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    return sorted(out)


def looks_live(secret: str) -> bool:
    """Whether a value looks random: enough bits a letter, two kinds of letters at least, and no placeholder in it."""
    n, low = len(secret), secret.lower()
    entropy = -sum(c / n * log2(c / n) for c in Counter(secret).values())
    kinds = any(c.isdigit() for c in secret) + any(c.islower() for c in secret) + any(c.isupper() for c in secret)
    return entropy >= MIN_ENTROPY and kinds >= 2 and not any(p in low for p in PLACEHOLDERS)


def _name(spans: list[tuple[int, int, int, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), wide_owners: int = WIDE_OWNERS,
    wide_repos: int = WIDE_REPOS,
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans, n_shared, n_live, most_repos, live_spans): a row per row of docs.

    Candidates are found in each whole text; their values' SHA-256 digests are counted over the corpus by distinct
    owners and repositories (the combinations of repo_cols).  A candidate is shared, a widely copied example, if its
    value has wide_owners owners, or two and wide_repos repositories.  Any other is specific to its owners, and live if
    it looks so (looks_live).  n_shared and n_live count a row's candidates, live_spans names the live ones, most_repos
    is the largest number of repositories that any of them has.

    Null texts count as empty, null owners and repositories as one owner or repository of their own.  Repeated rows
    stay and count once for their owner.  An empty table gives an empty result.  Other columns are not read.
    """
    kinds = KINDS + tuple(k for k, _ in EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_spans", "spans", "digests", "random"]
        kind_of = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        for batch in batches:
            cols: list[list] = [[] for _ in kind_of]
            for t in batch.column(3):
                text = t.as_py() or ""
                base = base_spans(text)
                extra = [(m.start(), len(KINDS) + i, m.end(), m[0]) for i, (_, p) in enumerate(EXTRA) if "-----BEGIN" in text or "eyJ" in text for m in p.finditer(text)]
                spans = sorted(base + extra)
                digests = [int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "little", signed=True) for *_, s in spans]
                row = (*(sum(k == i for _, k, _, _ in base) for i in range(3)), _name(base, kinds), _name(spans, kinds), digests, [looks_live(s) for *_, s in spans])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(cols, kind_of, strict=True))], names)

    repo = F.xxhash64(*[F.col(f"`{c}`") for c in repo_cols])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{owner_col}`")).alias("owner"), repo.alias("repo"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, owner long, repo long, n_assign long, n_access long, n_hex long, base_spans string, spans string, digests array<bigint>, random array<boolean>"
    found = stored(arrow_rows(rows, run, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = found.select("row", "owner", "repo", F.posexplode(F.arrays_zip("digests", "random")).alias("place", "x")).select("row", "owner", "repo", "place", F.col("x.digests").alias("digest"), "x.random")
    spread = each.select("digest", "owner", "repo").distinct().groupBy("digest").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    told = each.select("row", "place", "random", splittable("digest").alias("k")).join(spread.select(splittable("digest").alias("k"), "owners", "repos"), "k")
    shared = (F.col("owners") >= wide_owners) | (F.col("owners") >= 2) & (F.col("repos") >= wide_repos)
    live = ~shared & F.col("random")
    summed = told.groupBy("row").agg(
        F.count_if(shared).alias("n_shared"), F.count_if(live).alias("n_live"), F.max("repos").alias("most_repos"), F.array_sort(F.collect_list(F.when(live, F.col("place")))).alias("live")
    )  # a row's own candidates
    zero = F.lit(0).cast("long")
    live_spans = F.array_join(F.transform("live", lambda i: F.get(F.split("spans", ","), i)), ",")
    return found.join(summed, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", *[F.coalesce(c, zero).alias(c) for c in ("n_shared", "n_live", "most_repos")],
        F.coalesce(live_spans, F.lit("")).alias("live_spans"),
    )
