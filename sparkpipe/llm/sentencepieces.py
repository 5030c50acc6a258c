"""SentencePiece encoding and decoding with N-best segmentation (operator 7)."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress, count, islice, repeat
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_rows

SPACE = "▁"
#: No piece has a space mark after another letter, so paths of the lattice meet before each run of marks.
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Stands for a space mark that the text itself holds: a lone surrogate, which no text has.
_OWN = "\ud800"
#: Distinct chunks, and their characters, that a worker remembers: some 60 MB.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 4_000_000
#: Chunks of more characters are solved one by one, all others together.
SHORT = 48
#: Characters of texts that are taken apart together.
PART_CHARS = 300_000


class _Trie:
    """The model's pieces as a hash table of (node, letter) in numpy: one look-up steps many walks at once."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        prefixes = sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)}, key=len)
        node = {"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        letters = sorted({p[-1] for p in prefixes})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        place = {c: i for i, c in enumerate(letters, 1)}
        keys = np.array([node[p[:-1]] * self.width + place[p[-1]] for p in prefixes], dtype=np.int64)
        self.score = np.array([np.nan] + [pieces[p][0] if p in pieces else np.nan for p in prefixes])
        self.goes_on = np.zeros(len(prefixes) + 1, dtype=bool)
        self.goes_on[[node[p[:-1]] for p in prefixes]] = True
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several for one slot the last one stays
            here = self.keys[at] == keys[todo]
            self.nodes[at[here]] = todo[here] + 1
            todo, at = todo[~here], (at[~here] + 1) & (len(self.keys) - 1)
        #: The nodes of single letters.
        self.first = self.step(np.zeros(self.width, dtype=np.int32), np.arange(self.width))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by its letter, 0 where there is none."""
        keys = nodes.astype(np.int64) * self.width + letters
        at, out = self._slot(keys), np.zeros(len(keys), dtype=np.int32)
        todo = np.flatnonzero(letters)
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.nodes[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out


class _Places(dict):
    """Chunks by the place where their solution is or will be: one that is looked up for the first time gets the next."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        return place


class PieceLattice:
    """The lattice of a model's pieces: a segmentation's score is the sum of its pieces' scores.

    A letter without a piece is an edge of its UTF-8 byte pieces, at the lowest score less 10.  The library merges
    within a piece's reach only, so its ids of a text are those of its chunks, one after another.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece holds a space mark after a letter")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes((b,)) for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.trie = _Trie(self.pieces)
        self.forget()

    def forget(self) -> None:
        """Empties the cache of chunks."""
        self.known = _Places()
        self.held = 0
        self.scores, self.losses, self.ids = np.zeros(0), np.zeros(0), []
        self.uses = np.zeros(0, dtype=np.int64)

    def _make_room(self) -> None:
        """Of a full cache the chunks stay that came up again, at most half of what it holds."""
        keep = np.flatnonzero(self.uses > 1)
        if 2 * len(keep) > CACHE_CHUNKS:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_CHUNKS // 2])
        names = list(self.known)  # in the order of their places
        self.known = _Places((names[i], n) for n, i in enumerate(keep.tolist()))
        self.held = sum(map(len, self.known))
        self.scores, self.losses, self.uses = self.scores[keep], self.losses[keep], self.uses[keep] // 2
        self.ids = [self.ids[i] for i in keep.tolist()]
        if self.held > CACHE_CHARS:
            self.forget()

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the (start, score, ids) of the edges that lead there, longest first."""
        out: list[list] = [[]]
        get = self.pieces.get
        for end in range(1, len(chunk) + 1):
            here = []
            for start in range(max(0, end - self.longest), end):
                if (p := get(chunk[start:end])) is not None:
                    here.append((start, p[0], (p[1],)))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown, self._letter(chunk[end - 1])))
            out.append(here)
        return out

    def viterbi(self, edges: list) -> tuple[list[float], list[float], list[int]]:
        """Forward: best and second best score at each position, and the first edge of the best."""
        best, second, back = [0.0], [float("-inf")], [0]
        for here in edges[1:]:
            a = b = float("-inf")
            k = 0
            for i, (start, score, _) in enumerate(here):
                s = best[start] + score
                if s > a:
                    a, b, k = s, a, i
                elif s > b:
                    b = s
                if (s2 := second[start] + score) > b:
                    b = s2
            best.append(a)
            second.append(b)
            back.append(k)
        return best, second, back

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations: backward A-star, for which the forward scores are exact.

        A position is gone on from n times at most, since its n best tails hold those of the n best segmentations; so
        the many equal scores of a repeated letter cost no more than others.  Equal scores come in the order in which
        the search meets them: longest last pieces first.
        """
        edges = self.edges(chunk)
        best, _, _ = self.viterbi(edges)
        tie, out, visits = count(), [], [0] * len(edges)
        heap = [(-best[-1], next(tie), len(chunk), 0.0, None)]
        while heap and len(out) < n:
            f, _, at, tail, path = heapq.heappop(heap)
            if visits[at] >= n:
                continue
            visits[at] += 1
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for start, score, ids in edges[at]:
                heapq.heappush(heap, (-(best[start] + score + tail), next(tie), start, score + tail, (ids, path)))
        return out

    def _alone(self, chunk: str) -> tuple[float, float]:
        """Best score and what the second best loses, for one chunk."""
        best, second, _ = self.viterbi(self.edges(chunk))
        return best[-1], best[-1] - second[-1]

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best scores, and what the second best lose: the forward Viterbi of many short chunks at once.

        Tables have a row for each place and a column for each chunk, the longest first, so that the chunks that reach a
        place are the first columns.  At a place all chunks walk the trie together, and each piece relaxes its end.
        """
        lens = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        order = np.argsort(-lens, kind="stable")
        column = np.empty(len(chunks), dtype=np.int64)
        column[order] = np.arange(len(chunks))
        longest = int(lens.max())
        reach = np.searchsorted(-lens[order], -np.arange(longest + 2), side="right")  # chunks of so many letters at least
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letters = np.zeros((longest, len(chunks)), dtype=np.int32)
        letters[np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens), np.repeat(column, lens)] = self.trie.letter[code]
        best, second = np.full((longest + 1, len(chunks)), -np.inf), np.full((longest + 1, len(chunks)), -np.inf)
        best[0] = 0.0
        for at in range(longest):
            here = np.arange(reach[at + 1])
            node = self.trie.first[letters[at, : len(here)]]
            for end in range(at + 1, min(longest, at + self.longest) + 1):
                score = self.trie.score[node]
                piece = ~np.isnan(score)
                if end == at + 1:  # each letter is an edge
                    score, to = np.where(piece, score, self.unknown), here
                else:
                    score, to = score[piece], here[piece]
                new, old = best[at, to] + score, best[end, to]
                second[end, to] = np.maximum(np.maximum(second[end, to], second[at, to] + score), np.minimum(old, new))
                best[end, to] = np.maximum(old, new)
                on = self.trie.goes_on[node] & (node > 0)
                on[np.searchsorted(here, reach[min(end + 1, longest + 1)]) :] = False  # chunks that end here
                here, node = here[on], node[on]
                if not len(here):
                    break
                node = self.trie.step(node, letters[end, here])
                there = node > 0
                here, node = here[there], node[there]
        ends = best[lens, column]
        return ends, ends - second[lens, column]

    def _letter(self, letter: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (SPACE if letter == _OWN else letter).encode("utf-8", "replace"))

    def _model_ids(self, chunks: list[str]) -> list[bytes]:
        """The library's own ids (little-endian int32) of each chunk; the lattice's best where they don't give it back."""
        texts = "\n".join(chunks)
        plain = texts.replace(SPACE, " ").split("\n") if texts.count("\n") == len(chunks) - 1 else [c.replace(SPACE, " ") for c in chunks]
        ids = self.library.encode([t[1:] if _OWN not in t else "" for t in plain], num_threads=1)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype="<i4", count=int(sizes.sum()))
        raw = list(map(self.raw.get, flat.tolist(), repeat(b"")))
        stops = np.cumsum(sizes)
        packed = flat.tobytes()
        out = [packed[a:b] for a, b in zip((4 * (stops - sizes)).tolist(), (4 * stops).tolist(), strict=True)]
        code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        given = np.concatenate(([0], np.cumsum(width)))[np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))]
        made = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))))[stops]
        if not np.array_equal(given, made) or b"".join(raw) != "".join(plain).encode("utf-8", "replace") or _OWN in texts:
            for i, (chunk, text) in enumerate(zip(chunks, plain, strict=True)):
                if _OWN in chunk or b"".join(self.raw.get(x, b"") for x in ids[i]) != text.encode("utf-8", "replace"):
                    best = self.n_best(chunk, 1)[0][1]
                    out[i] = pack(f"<{len(best)}i", *best)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Solves the chunks that have got the next places, in their order."""
        best, loss = np.zeros(len(chunks)), np.zeros(len(chunks))
        short = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) <= SHORT
        if short.any():
            best[short], loss[short] = self.solve(list(compress(chunks, short.tolist())))
        for i in np.flatnonzero(~short).tolist():
            best[i], loss[i] = self._alone(chunks[i])
        self.scores, self.losses = np.concatenate((self.scores, best)), np.concatenate((self.losses, loss))
        self.ids += self._model_ids(chunks)
        self.uses = np.concatenate((self.uses, np.zeros(len(chunks), dtype=np.int64)))
        self.held += sum(map(len, chunks))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall(SPACE + text.replace(SPACE, _OWN).replace(" ", SPACE) if SPACE in text else SPACE + text.replace(" ", SPACE))

    def encode_all(self, texts: list[str], n: int) -> Iterator[tuple[bytes, list[tuple[float, dict[int, tuple[int, ...]]]]]]:
        """encode_n_best of each text; their new chunks are solved together."""
        if len(self.known) > CACHE_CHUNKS or self.held > CACHE_CHARS:
            self._make_room()
        taken = [self.chunks(t) for t in texts]
        places = [list(map(self.known.__getitem__, chunks)) for chunks in taken]
        if len(self.known) > len(self.ids):
            self.learn(list(islice(self.known, len(self.ids), None)))
        where = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=sum(map(len, places)))
        np.add.at(self.uses, where, 1)
        scores, losses, at = self.scores[where], self.losses[where], 0
        for chunks, place in zip(taken, places, strict=True):
            ids, end = b"".join(map(self.ids.__getitem__, place)), at + len(place)
            yield ids, self._n_best_of(chunks, float(scores[at:end].sum()), losses[at:end], n)
            at = end

    def encode(self, text: str, n: int) -> tuple[bytes, list[float]]:
        """The model's ids (little-endian int32) and the n best scores of the whole text's lattice."""
        ids, choices = self.encode_n_best(text, n)
        return ids, [s for s, _ in choices]

    def encode_n_best(self, text: str, n: int) -> tuple[bytes, list[tuple[float, dict[int, tuple[int, ...]]]]]:
        """The model's ids, and for each of the n best its score and the chunks in which it differs from the best, with their ids.

        Chunks are independent, so only the n - 1 whose second segmentation loses least can differ within the n best:
        A-star runs on these alone.
        """
        return next(self.encode_all([text], n))

    def _n_best_of(self, chunks: list[str], total: float, loss: np.ndarray, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        few = min(n - 1, len(loss))
        paths: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        if few > 0:
            near = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1])
            near = near[np.argsort(loss[near], kind="stable")][:few]
            for i in sorted(near[np.isfinite(loss[near])].tolist()):
                found = self.n_best(chunks[i], n)
                more = [(lost + found[0][0] - s, c if k == 0 else c | {i: p}) for lost, c in paths for k, (s, p) in enumerate(found)]
                paths = sorted(more, key=lambda x: x[0])[:n]
        return [(total - lost, c) for lost, c in paths]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation, the inverse of encode."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_lattices: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    """One lattice a worker process and model."""
    if path not in _lattices:
        _lattices[path] = PieceLattice(path)
    return _lattices[path]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts have PART_CHARS characters or so, a text at least."""
    lo, chars, texts = 0, 0, []
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or "")
        chars += len(texts[-1])
        if chars >= PART_CHARS or i == batch.num_rows - 1:
            yield batch.slice(lo, i + 1 - lo), texts
            lo, chars, texts = i + 1, 0, []


def _encoder(model_path: str, n_best: int, decoded: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattice(model_path)
        for batch in batches:
            for part, texts in _parts(batch):
                made = [(ids, [s for s, _ in paths]) for ids, paths in known.encode_all(texts, n_best)]
                values = np.frombuffer(b"".join(x for x, _ in made), "<i4")
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x, _ in made]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                columns, names = [part.column(0), ids, pa.array([s for _, s in made], pa.list_(pa.float64()))], ["doc_id", "ids", "scores"]
                if decoded:
                    columns.append(pa.array([zlib.crc32(known.decode(np.frombuffer(x, "<i4").tolist()).encode()) for x, _ in made], pa.int64()))
                    names.append("decoded_crc32")
                yield pa.RecordBatch.from_arrays(columns, names)
        known.forget()  # an idle worker keeps the model alone

    return run


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", n_best: int = 3, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, scores array<double>): the library's encoding of each whole text, and the lattice's n_best scores.

    A chunk (a word with the spaces before it) that the library's ids don't give back, such as one with a space mark of
    its own, has the lattice's best ids.  decoded adds decoded_crc32, of the UTF-8 bytes that the ids decode to.

    Null and empty texts have no pieces and one segmentation of score 0.  Repeated rows and null ids stay.  An empty
    table gives an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_rows(rows, _encoder(model_path, n_best, decoded), "doc_id long, ids array<int>, scores array<double>" + ", decoded_crc32 long" * decoded)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattice(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [known.decode(v.values.to_numpy(zero_copy_only=False).tolist()) if v.is_valid else None for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", n_best: int = 3) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, best_score, second_score, text_crc32): of encode_pieces' rows, text decoded back.

    second_score is null where a text has one segmentation only.  Encodes and decodes in one worker, which so holds one
    lattice and passes no ids on.
    """
    encode = _encoder(model_path, n_best, decoded=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_pieces", "ids_crc32", "best_score", "second_score", "text_crc32"]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for part in encode(batches):
            ids = [v.values.to_numpy(zero_copy_only=False) for v in part.column(1)]
            scores = [s + [None] for s in part.column(2).to_pylist()]
            cols = ([len(x) for x in ids], [zlib.crc32(x) for x in ids], [s[0] for s in scores], [s[1] for s in scores])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), part.column(3)], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_rows(rows, run, "doc_id long, n_pieces long, ids_crc32 long, best_score double, second_score double, text_crc32 long")
