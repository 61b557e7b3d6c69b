"""SentencePiece encoding and decoding: the best-scored segmentation, as a max-plus parallel scan.

A model file's pieces and scores are read as a unigram lexicon: of all ways to cut a text into pieces the
one with the largest sum of scores counts. A long document is split into chunks. A state at a boundary is
how many characters the piece across it reaches beyond; a chunk is a matrix of best sums from each state
at its begin to each at its end. Matrices are combined associatively in a tree, which gives the states of
the whole document's best path at every boundary, and each chunk is then traced back on its own.

No piece goes on past a space that follows something else, or touches a line break, so a chunk falls apart
into short segments there, and each different segment of many texts is cut once, all side by side.
Sums are whole numbers; equal sums are told apart by a number of their pieces, so the best path doesn't
depend on where chunks begin.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from facetwise.llm.common import mixed, plain

CHUNK = 32_768
SPACE = "▁"
#: Scores lower than this count as this; unknown characters score ten less than the least piece.
LOWEST = -(1 << 22)
#: Bits below the score that tell equal sums apart.
TIE_BITS = 44
#: The same for a segment of at most SHORT letters, whose sum fits 64 bits.
SHORT = 64
SHORT_TIE_BITS = 27
#: Letters of the texts that are cut at a time, and bytes of a batch.
SLICE = 1 << 18
#: Slots of the table of steps.
SLOT_BITS = 19


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def segment_starts(letters: np.ndarray) -> np.ndarray:
    """True where a segment begins: a line break, what follows one, and spaces after something else."""
    space, line = letters == ord(SPACE), letters == 10
    begins = line.copy()
    begins[:1] = True
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    return begins


class Lexicon:
    """Pieces of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = [model.id_to_piece(i) for i in range(len(model))]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.of_byte = {i: b for b, i in self.byte.items()}
        special = {i for i in range(len(model)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.weight: dict[str, tuple[int, int]] = {}
        least = 0
        for i, p in enumerate(self.text):
            if i not in special:
                score = max(LOWEST, round(model.get_score(i)))
                if score != LOWEST and score != model.get_score(i):
                    raise ValueError("piece scores must be whole numbers, as those of a merge model are")
                least = min(least, score)
                self.weight[p] = ((score << TIE_BITS) - zlib.crc32(b"%d" % i) % (1 << 20), i)
        # Pieces letter by letter, so that a search ends where no piece goes on: weight, id, what may follow.
        self.root: dict[str, list] = {}
        for p, (weight, i) in self.weight.items():
            node = self.root
            for letter in p:
                here = node.setdefault(letter, [None, 0, {}])
                node = here[2]
            here[:2] = weight, i
        self.unknown = (least - 10) << TIE_BITS
        self.longest = max(map(len, self.weight))
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.encode() for i, p in enumerate(self.text)]
        self._number_nodes()

    def _number_nodes(self) -> None:
        """The letter tree as arrays: a step from (node, letter) to a node, and what each node is worth."""
        steps, worth, piece = [], [0], [-1]
        todo = [(0, self.root)]
        while todo:
            at, below = todo.pop()
            for letter, (weight, i, after) in below.items():
                steps.append(((at << 21) + ord(letter), len(worth)))
                todo.append((len(worth), after))
                score = -(-(weight or 0) >> TIE_BITS)
                worth.append((score << SHORT_TIE_BITS) + (weight or 0) - (score << TIE_BITS))
                piece.append(-1 if weight is None else i)
        keys, nodes = np.array(sorted(steps), np.int64).T
        # The first letter has a table of its own, as every place of a text takes this step.
        roots = int(np.searchsorted(keys, 1 << 21))
        self.first = np.full(0x110000, -1, np.int32)
        self.first[keys[:roots]] = nodes[:roots]
        # The others are hashed, each to the first free slot from its own; a round places one key in each.
        self.step_key = np.full(1 << SLOT_BITS, -1, np.int64)
        self.step_node = np.full(1 << SLOT_BITS, -1, np.int32)
        keys, nodes = keys[roots:], nodes[roots:]
        slots = self.slots(keys)
        while len(keys):
            free = self.step_key[slots] < 0
            self.step_key[slots[free]] = keys[free]
            placed = self.step_key[slots] == keys
            self.step_node[slots[placed]] = nodes[placed]
            keys, nodes, slots = keys[~placed], nodes[~placed], (slots[~placed] + 1) % (1 << SLOT_BITS)
        self.worth, self.piece = np.array(worth, np.int64), np.array(piece, np.int32)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def step(self, node: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that the letters lead to, -1 for none."""
        key = (node.astype(np.int64) << 21) + letters
        slot = self.slots(key)
        found = self.step_key[slot]
        out = self.step_node[slot]
        todo = np.flatnonzero(found != key)
        out[todo] = -1
        todo = todo[found[todo] >= 0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) % (1 << SLOT_BITS)
            found = self.step_key[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.step_node[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    # -- cutting

    def best(self, text: str, begin: int, stop: int) -> tuple[list, list]:
        """From ``begin``: the best sums and the last pieces (-1: an unknown character) at every place; pieces
        begin before ``stop`` and may end after it."""
        n = len(text)
        letters = list(text)
        sums: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        sums[begin] = 0
        root, unknown = self.root, self.unknown
        for i in range(begin, min(stop, n)):
            here = sums[i]
            if here is None:
                continue
            found = root.get(letters[i])
            if found is None or found[0] is None:
                before = sums[i + 1]
                if before is None or here + unknown > before:
                    sums[i + 1], back[i + 1] = here + unknown, -1
            j = i
            while found is not None:
                j += 1
                weight, piece, after = found
                if weight is not None:
                    total = here + weight
                    before = sums[j]
                    if before is None or total > before:
                        sums[j], back[j] = total, piece
                if j == n:
                    break
                found = after.get(letters[j])
        return sums, back

    def trace(self, text: str, back: list, begin: int, end: int) -> list[int]:
        ids: list[int] = []
        pieces = self.text
        while end > begin:
            piece = back[end]
            if piece >= 0:
                ids.append(piece)
                end -= len(pieces[piece])
            else:
                ids += [self.byte[b] for b in reversed(text[end - 1].encode())]
                end -= 1
        return ids[::-1]

    def segment(self, text: str) -> Path:
        """Sum and ids of a segment that no piece leaves."""
        sums, back = self.best(text, 0, len(text))
        return sums[-1], np.array(self.trace(text, back, 0, len(text)), "<u4").tobytes()

    def search(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Short segments, end to end: sums (in short form), numbers of pieces, all pieces in order, and which
        segments hold an unknown character on their way (-1 among their pieces).

        The tree is walked from every place of every segment at once, which gives the pieces that fit. Sums
        grow place by place: a piece is taken after all that end before it begins, the longest first where
        several end at one place, as in ``best``.
        """
        begins = np.cumsum(sizes) - sizes
        slot = begins + np.arange(len(sizes))  # each segment has a place before every letter and one at its end
        within = np.arange(len(letters)) - np.repeat(begins, sizes)
        left = np.repeat(sizes, sizes) - within
        place = np.repeat(slot, sizes) + within

        froms, ends, nodes = [], [], []
        alive, node = np.arange(len(letters)), self.first[letters]
        lone = (node < 0) | (self.piece[node] < 0)
        depth = 1
        while True:
            fits = node >= 0
            alive, node = alive[fits], node[fits]
            full = self.piece[node] >= 0
            froms.append(alive[full])
            nodes.append(node[full])
            ends.append(np.full(int(full.sum()), depth))
            more = left[alive] > depth
            alive, node = alive[more], node[more]
            if not len(alive):
                break
            node = self.step(node, letters[alive + depth])
            depth += 1
        unknown = np.flatnonzero(lone)
        unknown_worth = -(-self.unknown >> TIE_BITS) << SHORT_TIE_BITS
        letter = np.concatenate([*froms, unknown])
        size = np.concatenate([*ends, np.ones(len(unknown), np.int64)])
        worth = np.concatenate([*(self.worth[n] for n in nodes), np.full(len(unknown), unknown_worth)])
        piece = np.concatenate([*(self.piece[n] for n in nodes), np.full(len(unknown), -1, np.int32)])
        group = ((within[letter] + size) * (self.longest + 1) + self.longest - size).astype(np.int16)
        order = np.argsort(group, kind="stable")
        origin, size, worth, piece = place[letter[order]], size[order], worth[order], piece[order]
        target = origin + size
        bounds = np.flatnonzero(np.diff(group[order])) + 1
        sums = np.full(len(letters) + len(sizes), np.iinfo(np.int64).min)
        sums[slot] = 0
        last = np.zeros(len(sums), np.int64)
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(order)]):
            here, total = target[a:b], sums[origin[a:b]] + worth[a:b]
            better = np.flatnonzero(total > sums[here])
            sums[here[better]] = total[better]
            last[here[better]] = a + better

        at, who = slot + sizes, np.arange(len(sizes))
        counts = np.zeros(len(sizes), np.int64)
        odd = np.zeros(len(sizes), bool)
        whose, which, taken = [], [], []
        while len(who):
            edge = last[at]
            whose.append(who)
            which.append(counts[who])
            taken.append(piece[edge])
            odd[who[piece[edge] < 0]] = True
            counts[who] += 1
            at = at - size[edge]
            on = at > slot[who]
            at, who = at[on], who[on]
        stop = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), np.int32)
        if len(ids):
            ids[stop[np.concatenate(whose)] - 1 - np.concatenate(which)] = np.concatenate(taken)
        return sums[slot + sizes], counts, ids, odd

    def paths(self, texts: list[str]) -> list[Path]:
        """Sums and ids of texts that no piece leaves, about SLICE letters of them at a time."""
        out: list[Path] = []
        at = 0
        while at < len(texts):
            end, letters = at, 0
            while end < len(texts) and letters < SLICE:
                letters += len(texts[end])
                end += 1
            out += self._paths(texts[at:end])
            at = end
        return out

    def _paths(self, texts: list[str]) -> list[Path]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return [(0, b"")] * len(texts)
        letters = code_points(joined)
        of_text = np.cumsum(lengths) - lengths
        begins = segment_starts(letters)
        begins[of_text[lengths > 0]] = True
        start = np.flatnonzero(begins)
        sizes = np.diff(start, append=len(letters))
        within = np.arange(len(letters)) - np.repeat(start, sizes)
        # Segments are told apart by a hash, then compared letter by letter with the one that stands for them.
        hashes = np.add.reduceat(mixed((letters + (within << 21)).astype(np.uint64) + np.uint64(1)), start)
        _, stands, kind = np.unique(hashes, return_index=True, return_inverse=True)
        same = sizes[stands[kind]] == sizes
        held = np.minimum(np.repeat(start[stands[kind]], sizes) + within, len(letters) - 1)
        same &= np.logical_and.reduceat(letters[held] == letters, start)
        other = np.flatnonzero(~same)
        kind[other] = len(stands) + np.arange(len(other))
        stands = np.concatenate([stands, other])

        size = sizes[stands]
        short = np.flatnonzero(size <= SHORT)
        begin = np.cumsum(size[short]) - size[short]
        flat = np.arange(int(size[short].sum())) + np.repeat(start[stands[short]] - begin, size[short])
        total, n, ids, odd = self.search(letters[flat], size[short])
        # Sums fall apart into scores and what tells equal ones apart, which add up without overflow.
        score, tie, counts = np.zeros(len(stands), np.int64), np.zeros(len(stands), np.int64), np.zeros(len(stands), np.int64)
        score[short], tie[short], counts[short] = -(-total >> SHORT_TIE_BITS), -total & ((1 << SHORT_TIE_BITS) - 1), n
        first = np.zeros(len(stands), np.int64)
        first[short] = np.cumsum(n) - n
        more, have = [], len(ids)
        for k in [*short[odd].tolist(), *np.flatnonzero(size > SHORT).tolist()]:
            begin = int(start[stands[k]])
            whole, raw = self.segment(joined[begin : begin + int(size[k])])
            score[k] = -(-whole >> TIE_BITS)
            tie[k] = (int(score[k]) << TIE_BITS) - whole
            first[k], counts[k] = have, len(raw) // 4
            more.append(np.frombuffer(raw, "<i4"))
            have += len(raw) // 4
        ids = np.concatenate([ids, *more])

        each = counts[kind]
        done = np.cumsum(each)
        raw = ids[np.arange(int(done[-1])) + np.repeat(first[kind] - done + each, each)].astype("<u4").tobytes()
        cuts = np.searchsorted(start, np.append(of_text, len(letters)))
        ids_at = (4 * np.append(0, done)[cuts]).tolist()
        scores, ties = (np.append(0, np.cumsum(v[kind]))[cuts] for v in (score, tie))
        sums = [(a << TIE_BITS) - b for a, b in zip(np.diff(scores).tolist(), np.diff(ties).tolist())]
        return [(v, raw[a:b]) for v, a, b in zip(sums, ids_at, ids_at[1:])]

    # -- chunks

    def edges(self, body: str, ahead: str) -> tuple[int, int] | None:
        """The first and last places of a chunk that no piece crosses, or None. Place 0 counts if the chunk
        begins at one, which its states then show."""
        places = np.flatnonzero(segment_starts(code_points(body)))[1:]
        return (int(places[0]), int(places[-1])) if len(places) else None

    def matrix(self, body: str, ahead: str) -> list[list]:
        """Best sums from each state at the chunk's begin to each at its end; None where there is no way."""
        size, n, text = self.longest, len(body), body + ahead
        edges = self.edges(body, ahead)
        if edges is None:
            rows = []
            for i in range(size):
                if i >= n:  # the piece reaches over the whole chunk
                    rows.append([0 if j == i - n else None for j in range(size)])
                    continue
                sums, _ = self.best(text, i, n)
                rows.append([sums[n + j] if n + j < len(sums) else None for j in range(size)])
            return rows
        first, last = edges
        inner = self._paths([body[first:last]])[0][0]
        tail, _ = self.best(text[last:], 0, n - last)
        ends = [tail[n - last + j] if n - last + j < len(tail) else None for j in range(size)]
        rows = []
        for i in range(size):
            head = self.best(body[:first], i, first)[0][first] if i <= first else None
            rows.append([None if head is None or e is None else head + inner + e for e in ends])
        return rows

    def ids(self, body: str, ahead: str, entry: int, leave: int) -> list[int]:
        """The best path's ids between two states of a chunk; pieces belong where they begin."""
        n, text = len(body), body + ahead
        if entry >= n:
            return []
        edges = self.edges(body, ahead)
        if edges is None:
            return self.trace(text, self.best(text, entry, n)[1], entry, n + leave)
        first, last = edges
        out = self.trace(body, self.best(body[:first], entry, first)[1], entry, first)
        out += np.frombuffer(self._paths([body[first:last]])[0][1], "<u4").tolist()
        tail = text[last:]
        return out + self.trace(tail, self.best(tail, 0, n - last)[1], 0, n - last + leave)

    def whole(self, text: str) -> list[int]:
        """Ids of a text in one chunk."""
        return np.frombuffer(self.paths([text])[0][1], "<u4").tolist()

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; a document's first chunk drops the space that encoding puts before it."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if first and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def lexicon_of(path: str) -> Lexicon:
    """The lexicon of a model file: one for all tasks of a worker."""
    return Lexicon(path)


def prepared(text: str) -> str:
    """Spaces made visible and one put before. Texts that hold the visible space itself come back with
    spaces in its place, as the model has no other form for it."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def combined(a: list[list], b: list[list]) -> list[list]:
    """The max-plus product: over two chunks in a row."""
    size = range(len(a))
    out = [[None] * len(a) for _ in size]
    for i in size:
        for k in size:
            if a[i][k] is not None:
                for j in size:
                    if b[k][j] is not None:
                        total = a[i][k] + b[k][j]
                        if out[i][j] is None or total > out[i][j]:
                            out[i][j] = total
    return out


def boundary_states(matrices: list[list[list]]) -> list[int]:
    """States of the best path at all boundaries, from 0 before the first to 0 after the last chunk.

    Up a tree of products, then down: each node splits its span where its two halves' sums are best.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([combined(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    spans = [(0, 0)]
    for level in levels[-2::-1]:
        below = []
        for p, (entry, leave) in enumerate(spans):
            if 2 * p + 1 == len(level):
                below.append((entry, leave))
                continue
            a, b = level[2 * p], level[2 * p + 1]
            ways = [(a[entry][k] + b[k][leave], -k) for k in range(len(a)) if a[entry][k] is not None and b[k][leave] is not None]
            k = -max(ways)[1]
            below += [(entry, k), (k, leave)]
        spans = below
    return [0, *(leave for _, leave in spans)]


# ---------------------------------------------------------------- jobs

def portions(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of a column, so that a task holds few texts at a time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


CODED = "doc_id long, text_key string, chunk_no int, copies long, ids binary"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, chunk_no, copies, ids): little-endian 32-bit ids; a document's ids are those of its
    chunks in order. text_key is null for a text of one chunk, else a 128-bit hash of the text.

    ``chunk``: characters of a chunk. Texts of one chunk are cut where they are read. Longer ones are dealt
    out by chunk, and only their matrices meet by document. Null and empty texts have one chunk without
    ids. Different texts of one id are told apart by text_key. Repeated rows of one chunk come back as often as
    they stand (copies 1), longer ones once, with their number as copies. Other columns are ignored; no rows
    give no rows.
    """
    short, long = encode_parts(docs, model, id_col, text_col, chunk)
    return short.union(long)


def encode_parts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows of ``encode``: of texts of one chunk, and of longer ones."""
    KEYS = ["doc_id", "text_key", "chunk_no"]
    rows = plain(docs, id_col, text_col)
    short = F.length("text") < chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model)
        for batch in portions(batches, 1):
            ids = [i for _, i in lexicon.paths([prepared(t.as_py()) for t in batch.column(1)])]
            one = [pa.nulls(len(ids), pa.string()), pa.array(np.zeros(len(ids), np.int32)), pa.array(np.ones(len(ids), np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *one, pa.array(ids, pa.binary())], [*KEYS, "copies", "ids"])

    longest = lexicon_of(model).longest

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                text = prepared(t.as_py())
                key = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
                for k, s in enumerate(range(0, len(text), chunk)):
                    cut = [d.as_py(), key, k, text[s : s + chunk], text[s + chunk : s + chunk + longest - 1]]
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(cut, kinds)], ["doc_id", "text_key", "chunk_no", "body", "ahead"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model)
        for batch in portions(batches, "body"):
            found = [json.dumps(lexicon.matrix(b.as_py(), a.as_py())) for b, a in zip(batch.column("body"), batch.column("ahead"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(found, pa.string())], [*KEYS, "matrix"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_no")
        found = boundary_states([json.loads(m.as_py()) for m in table["matrix"]])
        cut = table.select(KEYS)
        for name, values in (("entry", found[:-1]), ("leave", found[1:])):
            cut = cut.append_column(name, pa.array(values, pa.int32()))
        return cut

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model)
        for batch in portions(batches, "body"):
            ids = [np.array(lexicon.ids(*args), "<u4").tobytes() for args in zip(*(batch.column(c).to_pylist() for c in ("body", "ahead", "entry", "leave")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*KEYS, "copies"]), pa.array(ids, pa.binary())], [*KEYS, "copies", "ids"])

    kinds = "doc_id long, text_key string, chunk_no int"
    parts = rows.where(~short).mapInArrow(chunks, f"{kinds}, body string, ahead string")
    # Copies of a chunk are one row from here on; partial groups keep a text of very many copies small.
    parts = parts.groupBy(*KEYS).agg(F.first("body").alias("body"), F.first("ahead").alias("ahead"), F.count(F.lit(1)).alias("copies"))
    found = parts.mapInArrow(matrices, f"{kinds}, matrix string").groupBy("doc_id", "text_key").applyInArrow(states, f"{kinds}, entry int, leave int")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in KEYS]
    joined = parts.alias("p").join(found.alias("s"), same[0] & same[1] & same[2]).select("p.*", "s.entry", "s.leave")
    return rows.where(short).mapInArrow(whole, CODED), joined.mapInArrow(traced, CODED)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text_key, chunk_no, copies, text) of ``encode``'s rows; a document's text is that of its chunks in order."""
    KEYS = ["doc_id", "text_key", "chunk_no", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model)
        for batch in portions(batches, "ids"):
            texts = [
                lexicon.decode(np.frombuffer(i.as_buffer(), "<u4").tolist(), k == 0)
                for i, k in zip(batch.column("ids"), batch.column("chunk_no").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), pa.array(texts, pa.string())], [*KEYS, "text"])

    return coded.select(*KEYS, "ids").mapInArrow(run, "doc_id long, text_key string, chunk_no int, copies long, text string")


def digests(short: DataFrame, long: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text_sha256) per row of documents, repeated ones too, from the ids of
    ``encode_parts`` and from the text they decode to."""

    def row(ids: bytes, text: str) -> tuple[int, int, str]:
        return len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text.encode()).hexdigest()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model)
        for batch in portions(batches, "ids"):
            out = [row(i.as_py(), lexicon.decode(np.frombuffer(i.as_buffer(), "<u4").tolist())) for i in batch.column("ids")]
            n, c, h = zip(*out) if out else ((), (), ())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, DIGEST)

    def joined(table: pa.Table) -> pa.Table:
        lexicon = lexicon_of(model)
        table = table.sort_by("chunk_no")
        ids = [i.as_py() for i in table["ids"]]
        texts = [lexicon.decode(np.frombuffer(i, "<u4").tolist(), k == 0) for k, i in enumerate(ids)]
        values = [table["doc_id"][0].as_py(), *row(b"".join(ids), "".join(texts))]
        values.append(table["copies"][0].as_py())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [*DIGEST, "copies"])

    DIGEST = ["doc_id", "n_pieces", "ids_crc32", "text_sha256"]
    kinds = "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string"
    once = long.groupBy("doc_id", "text_key").applyInArrow(joined, f"{kinds}, copies long")
    each = once.select(*DIGEST, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*DIGEST)
    return short.mapInArrow(single, kinds).union(each)
