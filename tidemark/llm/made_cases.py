"""How well made cases of wrong decoding are found and restored, chain by chain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.llm.encodings import READ_AS, SHOWN, TEXTS_AT_ONCE, WRITTEN_IN, byte_table, find_garbled, restore, span_places
from tidemark.session import Scratch, arrow_batches


def chains() -> list[tuple[str, str]]:
    """(written, read) of every single wrong reading: of UTF-8, and of one single-byte encoding as another."""
    return [("utf_8", read) for read in READ_AS] + [(w, r) for w in WRITTEN_IN for r in READ_AS if w != r]


def misread(text: str, written: str, read: str) -> str | None:
    """The text written in one encoding and read in another; None where that loses a character or changes nothing."""
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    table = byte_table(read)
    bad = "".join(table[b] for b in raw)
    return None if bad == text or "�" in bad else bad


def made_cases(documents: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", sample: int = 4_000, seed: int = 0) -> DataFrame:
    """(chain, wholly, made, found, restored): of the cases made with each chain, how many are found and come back exactly.

    Cases are made of documents that find_garbled leaves clean and that hold no shown markup, at most `sample` of them,
    drawn by a hash: one after the other takes the next chain that can garble it, wholly or (every second) in one
    span. They are added to all documents, and find_garbled and restore run on the whole. Document ids are integers;
    cases get negative ones. The margins of the second run are validated on documents that the cases were held out of.
    """
    if sample < 1:
        raise ConfigError("the sample must be positive")
    d = documents.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    d = scratch.table(d, "documents")
    first = find_garbled(d, scratch)
    clean = d.filter(F.octet_length("text") > F.length("text")).join(first.documents.select("doc_id"), "doc_id", "left_anti")
    picked = clean.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("doc_id", "text", (F.row_number().over(_order(seed)) - 1).cast("bigint").alias("no"))
    ways = chains()

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for no, whole in zip(b["no"].to_pylist(), b["text"].to_pylist(), strict=True):
                places = list(span_places(whole, 0, len(whole)))
                if SHOWN.search(whole) or not places:
                    continue
                wholly = no % 2 == 0
                for turn in range(len(ways)):
                    written, read = ways[(no // 2 + turn) % len(ways)]
                    if wholly:
                        bad = misread(whole, written, read)
                    else:
                        i, j = places[(no // 2) % len(places)]
                        span = misread(whole[i:j], written, read)
                        bad = None if span is None else whole[:i] + span + whole[j:]
                    if bad is not None:
                        rows.append((-no - 1, bad, whole, f"{written}>{read}", wholly))
                        break
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["doc_id", "text", "original", "chain", "wholly"])

    with arrow_batches(d.sparkSession, TEXTS_AT_ONCE):
        cases = scratch.table(picked.mapInArrow(make, "doc_id bigint, text string, original string, chain string, wholly boolean"), "cases")
    both = scratch.table(d.unionByName(cases.select("doc_id", "text")), "both")
    second = find_garbled(both, scratch)
    back = restore(both, second).select("doc_id", "restored")
    scored = cases.join(back, "doc_id", "left")
    return scored.groupBy("chain", "wholly").agg(F.count(F.lit(1)).alias("made"), F.count("restored").alias("found"), F.count_if(F.col("restored") == F.col("original")).alias("restored"))


def _order(seed: int):
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")  # of at most `sample` rows
