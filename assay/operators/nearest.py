"""The k best documents of each query by BM25, without a row for each pair of a query and a document.

Nearly every document shares some word with every query, so the pairs are documents times queries, and a join has a row for each
word of a pair. Here each task scores its documents block by block against some thousand queries at once and keeps the k best of
each query: words that many documents and queries have are a dense product of matrices, the others go by postings. What is
shuffled is k rows for each query and task. Every pair is scored all the same, in doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of a block, postings met in a block, and entries of the dense matrix, at most: some 100 MB of a worker in all. Results don't depend on them.
PAIRS, POSTINGS, DENSE = 2_000_000, 2_000_000, 4_000_000
#: A product of the dense matrix costs this part of what a posting costs.
PRODUCT = 1 / 250
#: Documents of the first block, whose pairs are all candidates.
FIRST = 32


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero; no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits + 0.0


class Weights:
    """Some queries and the weights of their words, as arrays that can be sent to the executors.

    asked: (query, query_group, word, df, weight); a query without words has one row, whose word is null, and a word that no document has has no weight.
    """

    def __init__(self, asked: pa.Table, documents: int) -> None:
        one = asked.combine_chunks()
        query = one["query"].combine_chunks().dictionary_encode() if len(one) else pa.array([], one.schema.field("query").type).dictionary_encode()
        self.queries = query.dictionary
        at = query.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.unique(at, return_index=True)[1]
        self.groups = one["query_group"].combine_chunks().take(pa.array(first)) if len(one) else None
        has = one["weight"].is_valid().to_numpy() if len(one) else np.zeros(0, bool)
        at, one = at[has], one.filter(pa.array(has))
        weight, df = one["weight"].to_numpy(), one["df"].to_numpy()
        self.words = pc.unique(one["word"])
        word = pc.index_in(one["word"], value_set=self.words).to_numpy().astype(np.int64)
        # words by what their postings would cost, dearest first; the first are dense
        each = np.bincount(word, minlength=len(self.words))
        cost = np.zeros(len(self.words))
        cost[word] = df
        cost *= each
        order = np.argsort(-cost, kind="stable")
        most = DENSE // max(1, len(self.queries))
        self.dense = int(min(most, np.count_nonzero(cost > PRODUCT * documents * len(self.queries))))
        self.words = self.words.take(pa.array(order))
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        word = new[word]
        by = np.lexsort((at, word))
        self.at, self.weight = at[by], weight[by]
        self.start = np.concatenate([[0], np.cumsum(each[order])])
        self.positive = bool(np.all(weight > 0))


class Scorer:
    """Scores of blocks of documents against the queries of Weights."""

    def __init__(self, w: Weights, weight: np.ndarray) -> None:
        self.w, self.weight = w, weight
        self.matrix = np.zeros((w.dense, len(w.queries)))
        till = w.start[w.dense]
        self.matrix[np.repeat(np.arange(w.dense), np.diff(w.start[: w.dense + 1])), w.at[:till]] = weight[:till]

    def scores(self, row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """n documents times queries; value: a document's part of the score, by row and word."""
        w, wide = self.w, word < self.w.dense
        held = np.zeros((n, w.dense))
        held[row[wide], word[wide]] = value[wide]
        out = held @ self.matrix
        row, word, value = row[~wide], word[~wide], value[~wide]
        many = w.start[word + 1] - w.start[word]
        if total := int(many.sum()):
            posting = np.arange(total) + np.repeat(w.start[word] - (np.cumsum(many) - many), many)
            np.add.at(out.reshape(-1), np.repeat(row * len(w.queries), many) + w.at[posting], np.repeat(value, many) * self.weight[posting])
        return out


class Best:
    """The k best documents so far of each query; of equal scores the earlier documents."""

    def __init__(self, queries: int, k: int, digits: int, least: float) -> None:
        self.queries, self.k, self.digits = queries, k, digits
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit = np.full(queries, least)  # only what is above can be among the best: where k are known, what rounds to more than the last
        self.least = least

    def add(self, scores: np.ndarray, before: int) -> None:
        found = np.flatnonzero(scores > self.limit)
        query = np.concatenate([self.query, found % self.queries])
        place = np.concatenate([self.place, before + found // self.queries])
        score = np.concatenate([self.score, rounded(scores.reshape(-1)[found], self.digits)])
        order = np.lexsort((place, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = nth < self.k
        self.query, self.place, self.score = query[kept], place[order][kept], score[order][kept]
        last = nth[kept] == self.k - 1
        self.limit[self.query[last]] = np.maximum(self.least, self.score[last] + 0.4 * 10.0**-self.digits)


def task(weights: Callable[[], Weights], mean: float, k: int, digits: int, grouped: bool, fill: bool, k1: float, b: float, pairs: int, postings: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc, doc_group, w), in order of doc: (query, doc, score) of the task's k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        scorer = Scorer(w, w.weight)
        # a score above 0 tells that words are shared, unless there are weights that aren't
        hits = None if fill or w.positive else Scorer(w, np.ones(len(w.weight)))
        best = Best(len(w.queries), k, digits, -np.inf if fill or hits else 0.0)
        own = pc.index_in(w.groups, value_set=(names := pc.unique(w.groups))).to_numpy(zero_copy_only=False) if grouped else None
        docs, before, step = [], 0, first
        for batch in batches:
            texts, n = batch.column("w"), batch.num_rows
            docs.append(batch.column("doc"))
            long = texts.value_lengths().to_numpy(zero_copy_only=False)
            code = pc.index_in(batch.column("doc_group"), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False) if grouped else None
            word = pc.index_in(texts.flatten(), value_set=w.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), long)
            row, word = row[word >= 0], word[word >= 0]
            key, tf = np.unique(row * max(1, len(w.words)) + word, return_counts=True)
            row, word = key // max(1, len(w.words)), key % max(1, len(w.words))
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * long[row] / mean))
            many = np.where(word < w.dense, 0, w.start[word + 1] - w.start[word])
            met = np.concatenate([[0], np.cumsum(np.bincount(row, many, minlength=n))])
            at = 0
            while at < n:
                to = min(n, at + min(step, max(1, pairs // len(w.queries))), max(at + 1, int(np.searchsorted(met, met[at] + postings, "right")) - 1))
                i = slice(*np.searchsorted(row, [at, to]))
                scores = scorer.scores(row[i] - at, word[i], value[i], to - at)
                if hits:
                    scores[hits.scores(row[i] - at, word[i], np.ones(len(row[i])), to - at) == 0] = -np.inf
                if grouped:
                    np.putmask(scores, code[at:to, None] == own, -np.inf)
                best.add(scores, before + at)
                at, step = to, step * 4
            before += n
        if docs:
            doc = pa.chunked_array(docs).take(pa.array(best.place)).combine_chunks()
            yield pa.RecordBatch.from_arrays([w.queries.take(pa.array(best.query)), doc, pa.array(best.score)], ["query", "doc", "score"])

    return run
