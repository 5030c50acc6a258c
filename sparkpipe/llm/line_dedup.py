"""Line dedup by overlapping three-line windows (operator 2, DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import free_names, splittable, stored

#: Line ends and sentence ends, where a line that isn't blank follows.
_CUT = r"(?<=\n|[.!?] )(?=[ \t\r]*[^ \t\r\n])"
_BLANK = " \t\r\n"


def lines_of(text: Column) -> Column:
    """The lines of a text: cut at line ends and after `. `, `! ` and `? `; blank lines go with the line before them."""
    return F.split(F.substring(text, F.length(_lead(text)) + 1, F.lit(1 << 30)), _CUT)


def _lead(text: Column) -> Column:
    """Blank lines before the first line."""
    return F.regexp_extract(text, r"^[ \t\r\n]*\n(?=[ \t\r]*[^ \t\r\n])", 0)


def _windows(docs: DataFrame, lines: Column, window: int, min_bytes: int) -> DataFrame:
    """(id, content, pos, h): one row per window of a document."""
    trimmed = docs.select("id", "content", F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "").alias("lines"))
    hashed = trimmed.select("id", "content", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("n"))).alias("lines"))
    whole = F.col("lines")
    for i in range(1, window):
        here = F.when(F.size("lines") > i, F.slice("lines", i + 1, F.greatest(F.size("lines") - i, F.lit(0))))
        whole = F.zip_with(whole, here, lambda a, b: F.struct(F.xxhash64(a["h"], b["h"]).alias("h"), (a["n"] + b["n"]).alias("n")))
    full = F.when(F.size("lines") >= window, F.slice(whole, 1, F.greatest(F.size("lines") - (window - 1), F.lit(1))))
    at = hashed.select("id", "content", F.posexplode(full).alias("pos", "w"))
    return at.where(F.col("w.n") >= min_bytes).select("id", "content", (F.col("pos") + 1).alias("pos"), F.col("w.h").alias("h"))


def _covered(windows: DataFrame, window: int) -> DataFrame:
    """(id, content, flags): flags[i] says whether line i + 1 is covered by a later occurrence; lines after the flags are not."""
    repeated = windows.groupBy("h").agg(F.min(F.struct("id", "content", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        windows.select(splittable("h").alias("k"), F.struct("id", "content", "pos").alias("here")).join(repeated.select(splittable("h").alias("k"), "first"), "k")
        .where("NOT here <=> first").select("here.id", "here.content", "here.pos")
    )
    by_doc = Window.partitionBy("id", "content")
    before = F.lag("pos").over(by_doc.orderBy("pos"))
    island = later.distinct().withColumn("new", F.when(F.col("pos") <= before + window, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc.orderBy("pos")))
    runs = island.groupBy("id", "content", "island").agg(F.min("pos").alias("start"), (F.max("pos") + window - 1).alias("stop"))
    runs = runs.withColumn("free", F.col("start") - 1 - F.coalesce(F.lag("stop").over(by_doc.orderBy("start")), F.lit(0)))
    listed = runs.groupBy("id", "content").agg(F.array_sort(F.collect_list(F.struct("start", "free", (F.col("stop") - F.col("start") + 1).alias("gone")))).alias("runs"))
    flags = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.lit(False), r["free"].cast("int")), F.array_repeat(F.lit(True), r["gone"].cast("int")))))
    return listed.select("id", "content", flags.alias("flags"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3, min_bytes: int = 0) -> DataFrame:
    """docs with text_col cleaned, plus n_removed (long): the lines that went.

    Lines end at line breaks and at sentence ends (`. `, `! `, `? `), whatever their length, so that a passage on one
    line has windows too.  Blank lines don't count and go or stay with the line before them.  A window is `window`
    consecutive lines, equal if the trimmed lines are.  Of each window that occurs more than once, in one document or in
    several, the occurrence at the smallest (id, content, position) stays and the lines of the others go; overlapping
    windows go as one run.  min_bytes is a policy for windows that say too little: those of fewer bytes don't count.

    Null texts stay null, empty and shorter texts stay as they are.  A row is known by its id and its content's hash, so
    rows of one id, or without one, that differ in text are documents of their own; a null id sorts first.  Rows
    repeated with one id and text are one document: they lose nothing to each other and the same to others.  Columns of
    other names pass through; an n_removed that docs has is replaced.  An empty table gives an empty result.
    """
    key = {"id": F.col(f"`{id_col}`").cast("long"), "content": F.xxhash64(F.col(f"`{text_col}`"))}
    twice = docs.select(*[c.alias(n) for n, c in key.items()]).groupBy("id").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi")
    if twice.isEmpty():
        key["content"] = F.lit(0).cast("long")  # ids tell all documents apart, and the hash would cost each window 8 bytes
    source = docs.select(*[c.alias(n) for n, c in key.items()], F.col(f"`{text_col}`").alias("text"))
    covered = _covered(stored(_windows(source, lines_of(F.col("text")), window, min_bytes), "windows"), window)

    names = [c for c in docs.columns if c != "n_removed"]
    at, content, flags, lines = free_names(docs, "at", "content", "flags", "lines")
    covered = covered.select(F.col("id").alias(at), F.col("content").alias(content), F.col("flags").alias(flags))
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = own.join(covered, key["id"].eqNullSafe(F.col(at)) & (key["content"] == F.col(content)), "left")
    text, marked = F.col(f"`{text_col}`"), F.col(flags).isNotNull()
    joined = joined.withColumn(lines, F.when(marked, lines_of(text)))
    left = F.zip_with(lines, flags, lambda x, gone: F.when(F.coalesce(gone, F.lit(False)), "").otherwise(x))
    cleaned = F.when(marked, F.concat(_lead(text), F.array_join(left, ""))).otherwise(text)
    gone = F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0)).cast("long")
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], F.when(marked, gone).otherwise(0).alias("n_removed"))


#: DuckDB SQL for doc_id, text, n_removed over the table documents, whose ids differ.
ORACLE = r"""
WITH units AS (
  SELECT doc_id, regexp_extract_all(text, '[ \t\r]*(?:[.!?] |[^ \t\r\n][^\n]*?(?:\n|[.!?] |$))(?:[ \t\r]*\n)*(?:[ \t\r]+$)?') AS u FROM documents
), numbered AS (
  SELECT doc_id, unnest(u) AS l, generate_subscripts(u, 1) AS pos FROM units
), trimmed AS (
  SELECT *, trim(l, ' ' || chr(10) || chr(13) || chr(9)) AS t FROM numbered
), win AS (
  SELECT doc_id, pos, t AS a, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS c FROM trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), full_win AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM win WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM full_win, (VALUES (0), (1), (2)) v(i) WHERE nth > 1
), counted AS (
  SELECT n.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(l, '' ORDER BY n.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN regexp_extract(d.text, '^(?:[ \t\r]*\n)*') || c.text ELSE d.text END AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
