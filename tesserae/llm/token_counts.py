"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a parcel of texts form a trie, which is walked depth first, as the sorted pre-tokens give it: the
branch at hand holds the forward state of each prefix (the surviving piece, its path's score and number of tokens), found
once whatever pre-tokens share the prefix. A terminal's count and score are stored. A document's count is the
sum over its pre-tokens, and so is its score.

Defined cases: null and empty texts have no tokens and score 0; rows with a null id and repeated rows are counted
like others, one row per input row; pre-tokens may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import pieces, words
from tesserae.llm.storage import short_batches

#: Bytes of text whose pre-tokens share a trie.
PARCEL = 1 << 21


def trie_counts(vocab: pieces.Vocabulary, pre_tokens: Iterable[str]) -> Iterator[tuple[str, int, float]]:
    """Each distinct pre-token with its number of tokens and its forward score."""
    last, back, score, count = [-1], [0], [0.0], [0]
    before = ""
    for word in sorted(set(pre_tokens)):
        shared, n = 0, len(word)
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del last[shared + 1 :], back[shared + 1 :], score[shared + 1 :], count[shared + 1 :]
        vocab.advance(word, shared, n, 0, last, back, score)
        for at in range(shared + 1, n + 1):
            count.append(count[back[at]] + (1 if last[at] >= 0 else len(word[at - 1].encode())))
        yield word, count[n], score[n]
        before = word


def token_counts(docs: DataFrame, path: str | None = None, rule: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_distinct, n_tokens, score. No shuffle; a task keeps terminals in a memory
    of bounded size."""
    path = path or pieces.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces.vocabulary(path, rule)
        known = words.Memory()
        for rows, raw in words.parcels(batches, size=PARCEL):
            own = [pieces.SEGMENT.findall(pieces.prepared(t.decode())) for t in raw]
            distinct = [set(s) for s in own]
            every = set().union(*distinct)
            found = {w: (n, score) for w, n, score in trie_counts(vocab, known.missing(every))}
            here = {w: found.get(w) or known.young[w] for w in every}
            for w, terminal in found.items():
                known.put(w, terminal)
            counts, scores = ({w: t[i] for w, t in here.items()} for i in (0, 1))
            columns = [[len(s) for s in own], [len(s) for s in distinct], [sum(map(counts.__getitem__, s)) for s in own]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([sum(map(scores.__getitem__, s)) for s in own], pa.float64())],
                names=["doc_id", "n_pretokens", "n_distinct", "n_tokens", "score"],
            )

    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long, score double")
