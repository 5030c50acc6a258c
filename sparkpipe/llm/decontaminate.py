"""Benchmark decontamination by template windows and slot consistency (operator 1, DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import bounded, stored, without_rows

#: Unit words that count as a unit after a number.
UNITS = (
    "mm cm m km mg g kg t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "inch inches foot feet ft yard yards mile miles oz lb lbs pound pounds ounce ounces gram grams liter liters litre litres meter meters metre metres "
    "dollar dollars cent cents euro euros percent degrees kmh mph"
).split()
_TEENS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Words that count as numbers; the hyphen of twenty-five is gone as punctuation.
NUMBER_WORDS = (*_TEENS, *_TENS, *(t + u for t in _TENS for u in _TEENS[1:10]), *"dozen hundred thousand million billion trillion".split())
#: Words that are no names where they are capitalised, at a sentence's beginning or in a title.
FUNCTION_WORDS = (
    "a an the this that these those he she it we you they i his her its our your their my and or but nor so if then else when while where who whom "
    "whose which what why how is are was were be been am do does did has have had can could will would shall should may might must not no yes there "
    "here in on at by for from to of with without into over under after before during since until as than because although though let each every all "
    "both some any many much more most one two another other such only also now next first last"
).split()
#: A capitalised word, with what punctuation stands before it.
_NAMED = rf"(?<!\S)[^\p{{L}}\p{{N}}\s]*(?!(?i:{'|'.join(FUNCTION_WORDS)})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\S*"
#: Placeholders: private-use characters, which hold as word characters of their own.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
WINDOW = 8
#: Template windows of an item that a document must share, unless the item has fewer.
MIN_WINDOWS = 6
#: Words of a window that must be no placeholders.
MIN_LITERALS = 3
#: Benchmarks up to so many windows are broadcast, about 24 bytes each; larger ones are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000


def raw_words(text: Column) -> Column:
    """The words between white space that hold a letter or digit, as they stand."""
    return F.filter(F.split(text, r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def plain_words(text: Column) -> Column:
    """The same words in lower case and without punctuation, names with their mark before them."""
    named = F.regexp_replace(text, _NAMED, NAME + "$0")
    return F.split(F.btrim(F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{N}}\s{NUMBER}-{UNIT}]+", ""), F.lit(" \t\n\x0b\f\r")), r"\s+")


def template(words: str) -> Column:
    """Plain words with names, numbers and units as placeholders.  words: a column of its own, else it's made anew for each word."""
    before = F.col(words)
    return F.transform(
        words,
        lambda x, i: F.when(x.startswith(NAME), NAME).when(_number(x), NUMBER).when(x.isin(UNITS) & (i > 0) & _number(F.get(before, i - 1)), UNIT).otherwise(x),
    )


def literal(words: str) -> Column:
    """Plain words without the marks of names."""
    return F.transform(words, lambda x: F.when(x.startswith(NAME), F.substring(x, 2, 1 << 30)).otherwise(x))


def _number(word: Column) -> Column:
    return ~word.startswith(NAME) & (word.rlike("[0-9]") | word.isin(*NUMBER_WORDS))


def _windows(tokens: DataFrame, keep: list[str], lengths: list[int], rich_only: bool = False) -> DataFrame:
    """Two rows per window, the hashes of its template and of its literal words: keep, pos (from 1), len, h.

    rich_only: templates of too few ordinary words are left out.  The outer form of explode keeps the optimizer from
    making the tokens twice, for a filter before it.
    """
    out = None
    for n in lengths:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1)))
        hashes = [F.transform(c, lambda x: F.xxhash64(x)).alias(f"h_{c}") for c in ("tokens", "literal")]
        at = tokens.select(*keep, "tokens", *hashes).select("*", F.explode_outer(starts).alias("pos")).where("pos IS NOT NULL")
        here, words = (F.xxhash64(F.slice(f"h_{c}", F.col("pos"), n)) for c in ("tokens", "literal"))
        both = F.array(here, words)
        if rich_only:
            both = F.when(_rich("tokens", F.col("pos"), F.lit(n)), both).otherwise(F.array(words))
        w = at.select(*keep, "pos", F.lit(n).alias("len"), F.explode(both).alias("h"))
        out = w if out is None else out.union(w)
    return out


def _rich(tokens: str, pos: Column, length: Column) -> Column:
    """Whether the window holds enough ordinary words for its template to tell something."""
    return F.size(F.filter(F.slice(tokens, pos, length), lambda x: ~x.isin(NUMBER, NAME, UNIT))) >= F.least(F.lit(MIN_LITERALS), length)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, min_windows: int = MIN_WINDOWS, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, reparameterised, contaminated): a row per document and item that it leaks.

    Numbers (words with a digit, number words), units after a number, and names (capitalised words that are not in
    FUNCTION_WORDS, wherever they stand) become typed placeholders; other words lose case and punctuation.  Windows of
    `window` tokens are joined by hash, as templates and as literal words.  Windows that meet at one offset form an
    alignment, in which the item is then compared word by word; it leaks if min_windows of its windows agree, or all
    where it has fewer, and the slots fill consistently: equal values in the item stand for equal values in the
    document; different ones may stand for equal ones.  So many windows of equal literal words are a leak whatever the
    slots.  reparameterised tells whether a value differs.

    A document is known by its id and its text's hash, so texts that share an id, or have none, count apart, and rows
    repeated with one id and text give one row.  Null and empty texts leak nothing.  Items of fewer words than a window
    are one window, if they have three words; items without id or text are left out, of items of one id one counts.
    Templates with fewer than MIN_LITERALS ordinary words count only in an alignment with one that has more; an item
    without such a one leaks by its literal words.  An empty table on either side gives an empty result.  Other columns
    are not read.
    """
    columns = {"id_col": id_col, "text_col": text_col, "item_col": item_col, "item_text_col": item_text_col}
    return leaks(docs, benchmark, **columns, window=window, min_windows=min_windows, broadcast_windows=broadcast_windows).drop("content")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, each by its own text, with all their columns."""
    return without_rows(docs, leaks(docs, benchmark, id_col=id_col, text_col=text_col), id_col, text_col)


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, min_windows: int = MIN_WINDOWS, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """contaminated's rows with content, the hash of the document's text."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.dropDuplicates(["item_id"]).select("item_id", "text", plain_words(F.col("text")).alias("plain"))
    items = items.select("item_id", raw_words(F.col("text")).alias("braw"), template("plain").alias("tokens"), literal("plain").alias("literal"))
    size = F.least(F.size("tokens"), F.lit(window))
    lengths = sorted(n for n, in items.where(F.size("tokens") >= 3).select(size).distinct().collect())  # at most `window` numbers
    spark = docs.sparkSession
    if not lengths:
        return spark.createDataFrame([], "doc_id long, content long, item_id long, n_windows long, n_slots long, reparameterised boolean, contaminated boolean")
    marks = _windows(items, ["item_id", "tokens"], lengths, rich_only=True).where(size == F.col("len")).select("item_id", F.col("pos").alias("bpos"), "len", "h")
    n_marks = marks.count()

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"), F.col(f"`{text_col}`").alias("text"))
    source = source.where("text IS NOT NULL")
    words = source.select("doc_id", "content", plain_words(F.col("text")).alias("plain")).select("doc_id", "content", template("plain").alias("tokens"), literal("plain").alias("literal"))
    spots = _windows(words, ["doc_id", "content"], lengths)
    hit = spots.join(F.broadcast(marks) if n_marks <= broadcast_windows else marks, ["h", "len"])
    aligned = hit.groupBy("doc_id", "content", "item_id", (F.col("pos") - F.col("bpos")).alias("shift")).agg(F.countDistinct("bpos").alias("n"))
    places = F.sequence(F.lit(1), F.size("tokens") - size + 1)
    poor = F.size(F.filter(places, lambda p: ~_rich("tokens", p, size)))
    needed = F.least(F.lit(min_windows), F.size(places))
    items = items.withColumns({"size": size, "needed": needed, "poor": poor})
    aligned = aligned.join(items, "item_id").where(F.col("n") >= F.greatest(F.lit(1), F.col("needed") - F.col("poor"))).drop("n", "poor")
    aligned = stored(aligned, "aligned")
    key = F.struct(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), "content").alias("k")  # a struct: exchanges that can be split
    found = aligned.select(key, "*")
    texts = source.select(key, "text").join(bounded(found.select("k").distinct(), "leaking"), "k", "left_semi").dropDuplicates(["k"])
    both = found.join(texts.select("k", raw_words(F.col("text")).alias("draw"), plain_words(F.col("text")).alias("plain")), "k").select(
        *[c for c in found.columns if c != "k"], "draw", template("plain").alias("dtokens"), literal("plain").alias("dliteral")
    )
    first = F.greatest(F.lit(1), 1 - F.col("shift")).cast("int")
    last = F.least(F.size("tokens"), F.size("dtokens") - F.col("shift")).cast("int")
    at, span = (first + F.col("shift")).cast("int"), last - first + 1
    part = both.select(
        "doc_id", "content", "item_id", "size", "needed", F.slice("tokens", first, span).alias("bt"), F.slice("dtokens", at, span).alias("dt"),
        F.slice("literal", first, span).alias("bl"), F.slice("dliteral", at, span).alias("dl"),
        F.transform(F.slice("braw", first, span), _bare).alias("b"), F.transform(F.slice("draw", at, span), _bare).alias("d"),
    )
    part = stored(part, "compared")  # else lambdas below would make the words of the whole text anew for each element
    part = part.withColumn("words", F.zip_with("bl", "dl", lambda x, y: x == y))
    part = part.withColumn("same", F.zip_with("words", F.zip_with("bt", "dt", lambda x, y: x == y), lambda x, y: x | y))
    places = F.sequence(F.lit(1), F.size("bt") - F.col("size") + 1)

    def agreeing(flags: str) -> Column:
        return F.filter(places, lambda p: F.forall(F.slice(flags, p, F.col("size")), lambda x: x))

    part = part.withColumns({"hits": agreeing("same"), "exact": F.size(agreeing("words"))}).where(F.size("hits") >= F.col("needed"))
    lo = F.array_min("hits")
    span = F.array_max("hits") + F.col("size") - lo
    pairs = F.filter(F.slice(F.arrays_zip("bt", "same", "b", "d"), lo, span), lambda x: x["bt"].isin(NUMBER, NAME, UNIT) & x["same"])
    checked = part.withColumns({"slots": F.transform(pairs, lambda x: F.struct(x["b"].alias("b"), x["d"].alias("d"))), "rich": F.exists("hits", lambda p: _rich("bt", p, F.col("size")))})
    fits = F.col("rich") & (F.size(F.array_distinct("slots")) == F.size(F.array_distinct("slots.b")))
    changed = F.exists("slots", lambda x: x["b"] != x["d"])
    return (
        checked.withColumn("fits", fits).where(F.col("fits") | (F.col("exact") >= F.col("needed"))).groupBy("doc_id", "content", "item_id")
        .agg(
            F.max(F.when(F.col("fits"), F.size("hits")).otherwise(F.col("exact"))).cast("long").alias("n_windows"), F.max(F.size("slots")).cast("long").alias("n_slots"),
            F.min(F.col("fits") & changed).alias("reparameterised"),
        )
        .withColumn("contaminated", F.lit(True))
    )


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
