from sparkpipe.llm import line_dedup


def _cleaned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs).collect()), key=str)


def test_blank_lines_are_skipped(spark):
    passage = "The first paragraph here.\n\nThe second paragraph.\n \n\nThe third paragraph ends it."
    texts = [f"Alpha.\n\n{passage}\n\nOmega.\n", f"Beta.\n\n{passage}\n\nGamma.\n", "\n\n" + passage + "\n\n", "One.\n\nTwo.\n", "\n \n"]
    assert _cleaned(spark, list(enumerate(texts))) == [(0, texts[0], 0), (1, "Beta.\n\nGamma.\n", 3), (2, "\n\n", 3), (3, texts[3], 0), (4, texts[4], 0)]


def test_one_id_with_two_texts(spark):
    """Text that stands once stays, whatever shares its row's id; rows without an id are documents of their own."""
    copy, own = "a one.\nb two.\nc three.\n", "d four.\ne five.\nf six.\n"
    rows = [(1, copy), (2, copy), (2, own), (2, own), (None, "g. h. i. " + own), (None, "j. k. l. m")]
    # a null id sorts first, so its copy of `own` is the one that stays
    assert _cleaned(spark, rows) == sorted([(1, copy, 0), (2, "", 3), (2, "", 3), (2, "", 3), (None, "g. h. i. " + own, 0), (None, "j. k. l. m", 0)], key=str)


def test_lines_of_any_length_are_cut(spark):
    long = " ".join(f"Word{i}" for i in range(80)) + "."
    passage = f"{long} Second part of it! Was there a third? "
    got = _cleaned(spark, [(0, f"Start. {passage}End"), (1, f"Other {passage}Rest"), (2, f"Other. {passage}Tail")])
    assert [g[2] for g in got] == [0, 0, 3] and got[2][1] == "Other. Tail"


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1, 2, 3, 4), (2, "x\na\nb\nc", 1, 2, 3, 4)], "doc_id long, text string, _covered int, flags int, _FLAGS int, n_removed int")
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "_covered", "flags", "_FLAGS", "n_removed"]
    assert {(r.text, r._covered, r["_FLAGS"], r.n_removed) for r in got.collect()} == {("a\nb\nc", 1, 3, 0), ("x\n", 1, 3, 3)}


def test_short_windows_by_policy(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sum(r.n_removed for r in line_dedup.drop_repeated_lines(docs, min_bytes=4).collect()) == 0
