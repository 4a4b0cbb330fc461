"""SentencePiece encoding and decoding by streaming Viterbi.

A text is cut at boundaries that every lattice path has, and each segment is run through the streaming search of
tesserae.llm.pieces. Results for segments met before are kept in a memory of bounded size, as long as a task.

Defined cases: null and empty texts have no ids and decode to an empty text; a space mark (U+2581) in a text is
a space to the model, so it decodes to a space and `round_trip` is false; every other text decodes to itself; rows
with a null id and repeated rows are encoded like others, one row per input row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import pieces, words
from tesserae.llm.storage import short_batches


def encode(text: str, path: str, rule: str = "bpe", known: words.Memory | None = None) -> np.ndarray:
    """The ids of a whole text; a segment that is known isn't searched again."""
    vocab = pieces.vocabulary(path, rule)
    known = words.Memory() if known is None else known
    own = pieces.SEGMENT.findall(pieces.prepared(text))
    for segment in known.missing(set(own)):
        known.put(segment, b"".join([array("i", part).tobytes() for part in vocab.stream(segment)]))
    try:
        packed = [known.young[s] for s in own]
    except KeyError:  # the generations changed meanwhile
        packed = [known.young[s] if s in known.young else known.old[s] if s in known.old else array("i", chain.from_iterable(vocab.stream(s))).tobytes() for s in own]
    return np.frombuffer(b"".join(packed), "<i4")


def decode(ids: np.ndarray, path: str, rule: str = "bpe") -> str:
    spelt = pieces.vocabulary(path, rule).bytes_of
    return b"".join([spelt[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, path: str | None = None, rule: str = "bpe", id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, round_trip, and with_text the decoded text."""
    path = path or pieces.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Memory()
        for rows, raw in words.parcels(batches):
            texts = [t.decode() for t in raw]
            ids = [encode(t, path, rule, known) for t in texts]
            back = [decode(i, path, rule) for i in ids]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), pa.int32())
            columns = [
                rows.column("doc_id"),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32())),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(back)] * with_text, names=["doc_id", "ids", "n_tokens", "round_trip"] + ["decoded"] * with_text)

    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean" + ", decoded string" * with_text)


def decode_documents(encoded: DataFrame, path: str | None = None, rule: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of arrays of ids; a null array is an empty text."""
    path = path or pieces.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(np.array(i or [], np.int32), path, rule) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
