"""Packing: documents as pieces of token ids, put into sequences by first-fit decreasing."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetwise.llm.common import LOWER, SPACES, Docs, Words, ids_array, plain, slices, split_words, word_hashes

CAPACITY = 2048
END_ID = 1
#: A group of sequences is made of about this many documents and bytes of text.
GROUP_DOCS = 4096
GROUP_BYTES = 16 << 20
#: Words whose ids a task remembers; beyond it, it forgets them all.
MEMORY = 400_000
GROUP_BITS = 32


# ---------------------------------------------------------------- tokens


LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
#: ASCII signs but the apostrophe, which may begin a token of letters.
SIGNS = np.zeros(256, bool)
SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SIGNS[39] = False


def spans_of(part: Docs, added: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the tokenizer's added tokens in texts, from the left, none across two documents."""
    if not added:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    longest_first = b"|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    raw = part.data.tobytes()
    # Bytes of two documents lie end to end: each is searched apart only where a token is there at all.
    if not re.search(longest_first, raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = [m.span() for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()) for m in re.compile(longest_first).finditer(raw, a, b)]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def split_tokens(part: Docs, spans: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words cut further between ASCII letters and signs, where no token crosses either. ``spans`` are added tokens,
    each a run of its own."""
    words, data = split_words(part), part.data
    if not len(words.start):
        return words
    letter, sign = LETTERS[data], SIGNS[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    cut[part.offsets[part.offsets < len(data)]] = False  # the byte before is another document's
    cut[words.start] = True
    if spans is not None and len(spans[0]):
        begin, stop = spans
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, begin + 1, 1)
        np.add.at(inside, stop, -1)
        cut[np.cumsum(inside)[:-1] > 0] = False
        cut[begin] = True
        after = stop[stop < len(data)]
        cut[after] |= ~SPACES[data[after]]
    start = np.flatnonzero(cut)
    end = (words.start + words.length)[np.searchsorted(words.start, start, "right") - 1]
    end = np.minimum(end, np.append(start[1:], len(data)))
    return Words(start, end - start, np.searchsorted(start, part.offsets, "left"))


class Encoder:
    """Token ids of many texts. The tokenizer drops white space and the case of letters, and no token
    crosses a space or goes from ASCII letters to signs, so each different run is encoded once and the ids
    are put together by run. The tokenizer's added tokens, as they are written, are runs of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        # Runs are cut at white space and found before letters lose their case.
        plain = all(not (t.single_word or t.lstrip or t.rstrip or t.normalized) and not re.search(r"\s", t.content) for t in tokens)
        if not plain:
            raise ValueError("added tokens must be taken as they are written, without white space")
        self.added = [t.content.encode() for t in tokens]
        self.forget()

    def forget(self) -> None:
        """What is known: hashes of runs in order, where the ids of each begin, how many, and all ids."""
        self.hashes, self.begin = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.size, self.ids = np.empty(0, np.uint32), np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        parts, sizes = [self.ids], [self.size]
        for at in range(0, len(words), 20_000):
            some = [e.ids for e in encode([w.decode() for w in words[at : at + 20_000]], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in some], np.uint32))
            parts.append(np.array([i for x in some for i in x], np.uint32))
        self.ids = np.concatenate(parts)
        new = np.concatenate(sizes[1:]) if len(sizes) > 1 else np.empty(0, np.uint32)
        begin = np.concatenate([self.begin, (len(parts[0]) + np.cumsum(new, dtype=np.int64) - new).astype(np.uint32)])
        hashes, size = np.concatenate([self.hashes, hashes]), np.concatenate([self.size, new])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.begin, self.size = hashes[order], begin[order], size[order]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is in what is known, and whether it is."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, known

    def encode(self, part: Docs) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some documents, and how many each document has."""
        spans = spans_of(part, self.added)
        # Only an added token keeps its case.
        data = LOWER[part.data]
        for a, b in zip(*spans):
            data[a:b] = part.data[a:b]
        part = part._replace(data=data)
        words = split_tokens(part, spans)
        hashes, first, which = np.unique(word_hashes(part.data, words), return_index=True, return_inverse=True)
        _, known = self.places(hashes)
        if len(self.hashes) + np.count_nonzero(~known) > MEMORY:
            self.forget()
            known[:] = False
        new = np.flatnonzero(~known)
        raw = part.data.tobytes()
        places = zip(words.start[first[new]].tolist(), words.length[first[new]].tolist())
        self.learn(hashes[new], [raw[s : s + n] for s, n in places])
        at = self.places(hashes)[0][which]
        begin, n = self.begin[at].astype(np.int64), self.size[at].astype(np.int64)
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin - stop[:-1], n) + np.arange(stop[-1])]
        return ids, np.diff(stop[words.first])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's token ids and the end id,
    cut every ``capacity`` ids. ids: little-endian unsigned 32-bit numbers. A null text is empty."""
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for part in slices(batches, 3 << 20):
            flat, counts = encoder.encode(part)
            at, rows, cut = 0, [], []
            for d, n in enumerate(counts.tolist()):
                all_ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for s in range(0, n + 1, capacity):
                    piece = all_ids[s : s + capacity].tobytes()
                    rows.append((d, s, len(piece) // 4, zlib.crc32(piece), n + 1))
                    if ids:
                        cut.append(piece)
            table = np.array(rows, np.int64).reshape(-1, 5)
            arrays = [ids_array(part.ids[table[:, 0]]), *(pa.array(table[:, k]) for k in range(1, 5))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                arrays.append(pa.array(cut, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return plain(docs, id_col, text_col).mapInArrow(run, kinds)


# ---------------------------------------------------------------- sequences


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, longest first, each into the first bin with room.

    A tournament tree holds the room of the bins; each inner node has the most room below it, so the
    first bin that fits is found from the root down, turning left where the left side has room.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        if size > capacity:
            raise ValueError("a piece is longer than a sequence")
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
    return bins, offsets


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """Pieces with their sequence: all columns of ``cut`` and sequence_id, offset, sequence_length,
    padded_length.

    Pieces are dealt into ``groups`` at random, by a hash of document and start, and each group packs on
    its own, in the order of length, doc_id, start. Within a sequence offsets run on without gaps.
    Sequences are padded to ``capacity``, but those as long as a power of two stay as they are. Repeated
    pieces are packed each; null ids are ids of their own; no pieces give no sequences.
    """
    schema = cut.schema.simpleString()[7:-1].replace(":", " ")
    extra = "sequence_id long, offset long, sequence_length long, padded_length long"
    names = cut.columns

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group_no"]).sort_by([(c, "ascending") for c in ("doc_id", "start", "length")])
        sizes = table["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        total = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        padded = np.where(total & (total - 1), capacity, total)
        sequence = (np.int64(key[0].as_py()) << GROUP_BITS) + bins
        for name, values in zip(("sequence_id", "offset", "sequence_length", "padded_length"), (sequence, offsets, total, padded)):
            table = table.append_column(name, pa.array(values))
        return table

    dealt = cut.select(*names, F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(groups)).alias("group_no"))
    return dealt.groupBy("group_no").applyInArrow(run, f"{schema}, {extra}")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", ids: bool = True) -> DataFrame:
    """Documents as packed pieces: ``pieces`` and ``pack``. Other columns are ignored; no rows give no rows."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))).alias("b")).first()
    groups = max(1, math.ceil(size["n"] / GROUP_DOCS), math.ceil((size["b"] or 0) / GROUP_BYTES))
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, ids), groups, capacity)
