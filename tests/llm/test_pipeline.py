"""The pipeline over a small fixture against a plain Python version of its five stages."""

import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "ve") for b in ("ra", "se", "no") for c in ("d", "n", "l", "")]
RUDE = ("scumbag", "loathsome")
ITEM = "Tom carries 5 boxes to the red barn and then brings 12 smaller boxes back before the rain starts"


def _fixture():
    r = random.Random(21)

    def line(n=9):
        return " ".join(r.choice(WORDS) for _ in range(n)) + f" {r.randrange(10**6)}."

    passage = [line(20) for _ in range(4)]
    docs = []
    for i in range(140):
        lines = [line() for _ in range(r.randrange(6, 14))]
        if i % 7 == 0:
            lines[2:2] = passage[: 3 + i % 2]
        if i % 9 == 0:
            lines.insert(1, " ".join(RUDE) + " " + line(3))
        if i % 13 == 5:
            lines.append(ITEM.replace("5", str(3 + i)).replace("12", "99") + ".")
        docs.append((i, ("\n" if i % 2 else " ").join(lines)))
    base = docs[3][1].split(" ")
    docs += [(150, docs[4][1]), (151, " ".join([*base[:-4], "quite", "another", "end", "here"])), (151, docs[11][1] + " of the same id"), (152, " ".join(base[:40]))]
    docs += [(None, line(60)), (None, None), (160, None), (161, ""), (161, ""), (162, "  \n "), (None, ITEM), (163, "one"), (163, "one")]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(140)]
    return docs, labels


def _windows(text):
    cuts = [m.start() for m in re.finditer(r"(?<=\n)|(?<=[.!?] )", text)]
    parts = [text[a:b] for a, b in itertools.pairwise([0, *cuts, len(text)])]
    lines, lead = [], ""
    for p in parts:
        if p.strip(" \t\r\n"):
            lines.append(p)
        elif lines:
            lines[-1] += p
        else:
            lead += p
    return lead, lines


def _plain(docs):
    docs = [d for d in docs if not (d[1] and all(w in d[1] for w in RUDE))]
    # windows of three lines: the first occurrence by (id, position) stays, equal rows are one
    seen, out = {}, {}
    keys = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    for d in keys:
        lead, lines = _windows(d[1] or "")
        gone = set()
        trimmed = [x.strip(" \t\r\n") for x in lines]
        for p in range(len(lines) - 2):
            w = tuple(trimmed[p : p + 3])
            if seen.setdefault(w, (d, p)) != (d, p):
                gone |= {p, p + 1, p + 2}
        out[d] = (lead + "".join(x for i, x in enumerate(lines) if i not in gone), len(gone)) if gone else (d[1], 0)
    docs = [(d[0], out[d][0]) for d in docs if not out[d][1] or out[d][0].strip(" ")]
    # near duplicates by five-word shingles
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    first = {}
    for i in rows:
        first.setdefault(label[i], i)
    docs = [d for i, d in enumerate(docs) if not sets[i] or first[label[i]] == i]
    leak = re.compile(re.escape(ITEM).replace("5", r"\d+").replace("12", r"\d+"))
    docs = [d for d in docs if not (d[1] and leak.search(d[1]))]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((str(i), tuple(sp.encode(t or "")), zlib.crc32((t or "").encode())) for i, t in docs)


@pytest.mark.parametrize("part", ["whole", "no documents"])
def test_against_plain_python(spark, tmp_path, part):
    docs, labels = _fixture()
    docs = docs if part == "whole" else []
    frame = spark.createDataFrame([(i, t, "en", f"s{n % 3}", n, 7) for n, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, content int, at int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded_crc32) for r in got) == _plain(docs)
    assert all(r.n_pieces == len(r.ids) for r in got)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns
