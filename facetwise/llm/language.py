"""Language identification by compression: the dictionary that shrinks a text most names its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from facetwise.llm.common import plain, plain_columns

UNKNOWN = "und"
#: Sample that a language's dictionary is made of: texts, and characters of each.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 2_000
#: Above this many languages the job stops rather than let dictionaries outgrow a task.
MAX_LANGUAGES = 500
#: Rejected: the best code is shorter than the second-best by less than this part.
MARGIN = 0.005
#: Effort of the codes; where the first leaves less than NARROW between the best two, the second is added.
LEVELS = (9, 12)
NARROW = 0.03
#: A text is coded in pieces of about so many bytes, each with the dictionary fresh, so that what a dictionary
#: saves does not shrink with the length of the text.
PIECE_BYTES = 8 << 10
#: Rows that a task gives back at a time.
ROWS = 500
LETTER = regex.compile(r"\p{L}")


def training_rows(id_col: str = "doc_id") -> Column:
    """Documents whose crc32 of the id, as text, leaves no remainder of two by four; null ids are learned from."""
    return ~F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each language, of at most ``texts`` times ``chars`` characters.

    The sample: ids are dealt into ``texts`` groups by hash, and each group gives, for each language,
    the text of the smallest hash; of rows that share id (or its lack) and language, the text whose beginning has
    the smallest hash. The rows are found by hashes alone; at most ``texts`` texts a language reach the driver.
    Rows with null or letterless text or null language are left out.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    mark, pair = F.xxhash64("doc_id"), F.xxhash64("lang", "doc_id")
    best = rows.groupBy("lang", F.pmod(mark, F.lit(texts)).alias("part")).agg(F.min_by(pair, mark).alias("pair"))
    wanted = [r["pair"] for r in best.limit(texts * MAX_LANGUAGES + 1).collect()]
    if len(wanted) > texts * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not wanted:
        return {}
    begin = F.substring("text", 1, chars)
    found = rows.where(pair.isin(wanted)).groupBy("lang", mark.alias("mark")).agg(F.min(F.struct(F.xxhash64(begin), begin.alias("text"))).alias("first"))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in found.collect():
        by_lang.setdefault(r["lang"], []).append((r["mark"], r["first"]["text"]))
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode() for k, v in sorted(by_lang.items())}


def coders_of(dictionaries: list[bytes], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def pieces_of(text: bytes) -> list[bytes]:
    """A UTF-8 text in pieces of nearly equal size, at most about PIECE_BYTES, cut between characters."""
    n = -(-len(text) // PIECE_BYTES) or 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    for k in range(1, n):
        while text[cuts[k]] & 0xC0 == 0x80:
            cuts[k] -= 1
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


def code_lengths(text: bytes, coders: list[list[zstandard.ZstdCompressor]]) -> list[int]:
    """Bytes of the codes of the text's pieces with each dictionary, summed; with more effort too where two
    are nearly as short."""
    pieces = pieces_of(text)
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders[0]]
    two = sorted(sizes)[:2]
    if len(two) == 2 and two[1] - two[0] < NARROW * two[1]:
        sizes = [s + sum(len(c.compress(p)) for p in pieces) for s, c in zip(sizes, coders[1])]
    return sizes


def identify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             margin: float = MARGIN, whole_row: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row; with ``whole_row`` also row, a struct of its columns.

    The whole text, in lower case, is compressed in pieces with each language's dictionary; the shortest sum wins,
    ties go to the first name. score is the part by which it is shorter than the second-best, from 0 to 1. Rejected: no language at all, or that part under ``margin``. Null or
    letterless text, or an empty model: ``und``, score 0, rejected. Repeated rows and null ids come back
    as they are; other columns are ignored; no rows give no rows.
    """
    names = sorted(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [coders_of([model[n] for n in names], level) for level in LEVELS]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            langs, scores = [], []
            for text in batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text_col):
                text = text.as_py() or ""
                if not names or not LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sizes = code_lengths(text.lower().encode(), coders)
                best = int(np.argmin(sizes))
                rest = min(sizes[:best] + sizes[best + 1 :], default=2 * sizes[best])
                langs.append(names[best])
                scores.append(1.0 - sizes[best] / rest)
            kept = [batch.column(c) for c in names_kept]
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*names_kept, "lang_pred", "score"])

    rows = plain(docs, id_col, text_col)
    names_kept, kinds = ["doc_id"], "doc_id long, "
    if whole_row:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        in_row = docs.schema[text_col].dataType == T.StringType()  # then the text need not come twice
        rows = docs.select(row, *plain_columns(id_col, text_col)[: 1 if in_row else 2])
        names_kept, kinds = ["row", "doc_id"], f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, "
    return rows.mapInArrow(run, kinds + "lang_pred string, score double").withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin)
    )
