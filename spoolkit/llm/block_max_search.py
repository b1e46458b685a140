"""Exact BM25 top-k over sharded inverted indexes with block-max WAND pruning.

Each task indexes its documents as one or more shards: sorted 64-bit word
hashes, for each word its blocks of ``BLOCK`` documents, and the postings.
Document frequencies and the mean length are global, so scores are comparable
between shards and a merge of the shards' top k is exact.

Queries run in blocks of bounded size, in two waves.  The first wave takes one
shard in ``WAVES``; the k-th best score that a query finds there is a lower
bound of its final one, and is where its search of all other shards begins.

A shard meets all queries of a block at once: a posting of a word is added to
the scores of the queries that hold the word, so what a search costs beside its
postings is shared by the queries.  Words that many queries hold are rows of a
matrix of a block's documents, which is multiplied with the queries'.  Of these
a query's words stand by falling bound (the largest contribution of any posting);
those whose bounds sum to less than ``DEPTH`` of the least score wanted are left
out at first.  A block whose best document can't reach the least score with the
block maxima of the words left out is skipped for that query, and so is the shard
if all bounds together don't reach it; in the other blocks these words are added
too.  Ties are kept, for they go to the smaller document id.

Contributions are multiples of 2**-38, so sums below 16,384 are exact whatever
the order, and equal texts have equal scores in every shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, texts_of
from spoolkit.llm.shingles import word_hashes
from spoolkit.storage import new_path, shared_dir, stored

K1, B = 1.2, 0.75
#: Documents of a block; postings and documents at which a shard is closed (numbers of documents fit 16 bits).
BLOCK, SHARD_POSTINGS, SHARD_DOCS = 32, 1_000_000, 60_000
#: Words of the queries that run together, and queries of one block.
QUERY_WORDS, QUERIES = 2_000_000, 16_384
#: Words whose numbers of documents a task adds up before it hands them on.
COUNTED_WORDS = 1_000_000
#: One shard in so many is searched first.
WAVES = 8
#: Share of the least score that the words whose postings aren't added up at first may sum to.
DEPTH = 0.5
#: A word that one query of a block in so many holds, or more, is frequent; so many words at most.
OFTEN, ROWS = 8, 256
#: Blocks whose maxima are added up together; results of a shard after which only the best of each query stay.
TOGETHER, KEPT = 16, 1_000_000
#: The grid of contributions.
GRID = 2.0**38

_FIELDS = (("docs", "<i8"), ("lengths", "<f8"), ("words", "<i8"), ("first_block", "<i4"), ("block", "<u2"), ("first_posting", "<i4"), ("doc", "<u2"), ("times", "<f4"))


class Shard:
    """Postings by word, and within a word by document.

    ``first_block[w]`` is where the blocks of word w begin, ``block`` their
    numbers and ``first_posting`` where the postings of each begin.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, docs: list[int], lengths: list[int], words: list[np.ndarray], times: list[np.ndarray]) -> Shard:
        sizes = [len(w) for w in words]
        word, doc = np.concatenate(words), np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        order = np.argsort(word, kind="stable")
        word, doc, count = word[order], doc[order], np.concatenate(times)[order].astype(np.float32)
        block = doc // BLOCK
        new_word = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
        new_block = new_word | np.concatenate([[True], block[1:] != block[:-1]])[: len(word)]
        starts = np.flatnonzero(new_block)
        return cls({
            "docs": np.array(docs, np.int64), "lengths": np.array(lengths, np.float64), "words": word[new_word],
            "first_block": np.append(np.flatnonzero(new_word[starts]), len(starts)), "block": block[starts].astype(np.int32),
            "first_posting": np.append(starts, len(word)), "doc": doc, "times": count,
        })

    def pack(self) -> bytes:
        parts = [getattr(self, n).astype(k).tobytes() for n, k in _FIELDS]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def view(cls, data: bytes) -> Shard:
        sizes, at, arrays = np.frombuffer(data, "<i8", len(_FIELDS)), 8 * len(_FIELDS), {}
        for (name, kind), n in zip(_FIELDS, sizes.tolist(), strict=True):
            arrays[name] = np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at)
            at += n + -n % 8
        return cls(arrays)

    def ready(self, mean: float, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Contributions of all postings, their maxima by block and word, and where each of the ``known`` words (sorted) is, -1 for nowhere."""
        if not len(self.words):
            return np.full(len(known), -1)
        at = np.minimum(np.searchsorted(self.words, known), len(self.words) - 1)
        at[self.words[at] != known] = -1
        weight = np.zeros(len(self.words))
        weight[at[at >= 0]] = weights[at >= 0]
        norm = K1 * (1 - B + B * self.lengths / mean) if mean else np.full(len(self.docs), K1)
        self.first = self.first_posting[self.first_block]  # of each word, and the end
        gain = norm[self.doc]
        gain += self.times
        np.divide(self.times, gain, out=gain)
        gain *= np.repeat(weight * (K1 + 1) * GRID, np.diff(self.first))
        np.rint(gain, out=gain)
        gain /= GRID
        self.gain = gain
        self.top = np.maximum.reduceat(self.gain, self.first_posting[:-1])
        self.best = np.maximum.reduceat(self.top, self.first_block[:-1])
        self.blocks = -(-len(self.docs) // BLOCK)
        self.opened = self.skipped = 0  # blocks whose remaining postings were, or weren't, touched
        return at

    def search(self, words: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of this shard that score ``least`` or more, best first; ``words``: numbers in this shard."""
        asked = Asked(len(words), np.array([0, len(words)]), np.arange(len(words)))
        _, docs, scores = self.search_all(words, asked, k, np.zeros((1, k)), np.array([least], np.float64))
        return docs, scores

    def search_all(self, at: np.ndarray, asked: Asked, k: int, best: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores): each query's k best that score what it wants or more, best first.

        ``at``: where the words of ``asked`` are.  ``best`` (the k best scores that
        a query has seen) and ``least`` are brought up to date.
        """
        n, here = asked.n, at >= 0
        bound = np.zeros(len(at))
        bound[here] = self.best[at[here]]
        if not len(self.docs) or not (np.bincount(asked.query, np.repeat(bound, np.diff(asked.first)), n) * (1 + 1e-12) >= least).any():
            self.skipped += self.blocks * n
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # frequent words by falling bound: what of each query is added up, and what only where a block's maxima don't rule it out
        by = np.argsort(-bound[asked.often], kind="stable")
        often, holds = asked.often[by], asked.holds[by]
        rest = np.cumsum((holds * bound[often][:, None])[::-1], axis=0)[::-1] * (1 + 1e-12)  # bound of a word and all after it
        lead = holds * (rest > DEPTH * least)
        tail = np.ascontiguousarray((holds - lead).T)
        tops = np.zeros((self.blocks, len(often)))
        for i, w in enumerate(at[often].tolist()):
            if w >= 0:
                cells = slice(self.first_block[w], self.first_block[w + 1])
                tops[self.block[cells], i] = self.top[cells]
        # postings of the queries' words by document; of frequent words by row
        word = np.full(len(self.words), -1)
        word[at[here]] = np.flatnonzero(here)
        word = np.repeat(word, np.diff(self.first))
        mine = np.flatnonzero(word >= 0)
        mine = mine[np.argsort(self.doc[mine], kind="stable")]
        word, doc, gain = word[mine], self.doc[mine], self.gain[mine]
        row = np.full(len(at), -1)
        row[often] = np.arange(len(often))
        row = row[word]
        frequent = row >= 0
        row, row_doc, row_gain = row[frequent], doc[frequent], gain[frequent]
        word, doc, gain = word[~frequent], doc[~frequent], gain[~frequent]
        first, holders = asked.first[word], np.diff(asked.first)[word]
        ends = np.searchsorted(doc, np.arange(len(self.docs) + 1)).tolist()
        row_ends = np.searchsorted(row_doc, np.arange(self.blocks + 1) * BLOCK).tolist()
        found, size = [], 0
        for j in range(self.blocks):
            if j % TOGETHER == 0:
                more = tops[j : j + TOGETHER] @ tail.T * (1 + 1e-12)
            low = j * BLOCK
            docs, mine = min(BLOCK, len(self.docs) - low), slice(row_ends[j], row_ends[j + 1])
            table = np.zeros((docs, len(often)))
            table[row_doc[mine] - low, row[mine]] = row_gain[mine]
            total = table @ lead
            for i in range(docs):
                a, b = ends[low + i], ends[low + i + 1]
                if b > a:
                    m = holders[a:b]
                    end = np.cumsum(m)
                    whose = np.arange(end[-1])
                    whose += np.repeat(first[a:b] - (end - m), m)
                    total[i] += np.bincount(asked.query.take(whose), np.repeat(gain[a:b], m), n)
            open_ = np.flatnonzero(total.max(axis=0) + more[j % TOGETHER] >= least)
            self.opened += len(open_)
            self.skipped += n - len(open_)
            score = total[:, open_] + table @ tail[open_].T
            hit = ((score >= least[open_]) & (score > 0)).any(axis=0)
            if hit.any():
                query, score = open_[hit], score[:, hit]
                best[query] = np.partition(np.concatenate([best[query], score.T], axis=1), docs, axis=1)[:, docs:]
                least[query] = np.maximum(least[query], best[query].min(axis=1))
                i, of = np.nonzero((score >= least[query]) & (score > 0))
                found.append((query[of], self.docs[low + i], score[i, of]))
                size += len(i)
                if size > KEPT:
                    found, size = [_leading(found, k)], 0
        return _leading(found, k)


def _leading(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query of ``found`` (queries, documents, scores), by query, best first."""
    query, docs, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((docs, -score, query))
    query, docs, score = query[order], docs[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], docs[keep], score[keep]


class Asked:
    """The queries of a block by word: ``query[first[w] : first[w + 1]]`` are those that hold word w.

    Of the words that are frequent among them (``often``), ``holds`` tells
    which query holds which.
    """

    def __init__(self, words: int, first: np.ndarray, held: np.ndarray):
        """``held[first[i] : first[i + 1]]``: the words of query i, of ``words`` words."""
        self.n = len(first) - 1
        query, counts = np.repeat(np.arange(self.n), np.diff(first)), np.bincount(held, minlength=words)
        self.query, self.first = query[np.argsort(held, kind="stable")], np.append(0, np.cumsum(counts))
        often = np.flatnonzero((counts * OFTEN >= self.n) & (counts > 0))
        self.often = often[np.argsort(-counts[often], kind="stable")[:ROWS]]
        row = np.full(words, -1)
        row[self.often] = np.arange(len(self.often))
        self.holds = np.zeros((len(self.often), self.n))
        row = row[held]
        self.holds[row[row >= 0], query[row >= 0]] = 1


def build_index(docs: DataFrame) -> DataFrame:
    """``wave, n_docs, n_words, shard`` over the rows of ``docs`` (doc_id, text) that have an id; wave 0 is searched first."""
    bounded_batches(docs.sparkSession)
    waves = WAVES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, words, times, size = [], [], [], [], 0
        number = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            columns = [pa.array([x], pa.int64()) for x in (min(number % waves, 1), len(docs), sum(lengths))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([Shard.build(docs, lengths, words, times).pack()], pa.binary())], ["wave", "n_docs", "n_words", "shard"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found, n = np.unique(word_hashes(text).view(np.int64), return_counts=True)
                docs.append(doc)
                lengths.append(int(n.sum()))
                words.append(found)
                times.append(n.astype(np.int32))
                size += len(found)
                if size >= SHARD_POSTINGS or len(docs) >= SHARD_DOCS:
                    yield out()
                    number += 1
                    docs, lengths, words, times, size = [], [], [], [], 0
        if docs:
            yield out()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(work, "wave long, n_docs long, n_words long, shard binary")


def _one_shard_at_a_time(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[Shard]:
    for batch in batches:
        for i in range(len(batch)):
            yield Shard.view(batch.column(column)[i].as_py())


def _frequencies(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``word, df`` of the words in ``wanted`` (word), over all shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the shards so far, added up

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(df)], ["word", "df"])

        for shard in _one_shard_at_a_time(batches, 0):
            found, back = np.unique(np.concatenate([words, shard.words]), return_inverse=True)
            words, df = found, np.bincount(back, weights=np.concatenate([df, np.diff(shard.first_posting[shard.first_block])])).astype(np.int64)
            if len(words) > COUNTED_WORDS:
                yield out()
                words, df = words[:0], df[:0]
        if len(words):
            yield out()

    counts = index.select("shard").mapInArrow(work, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return wanted.join(counts, "word")


def _query_words(queries: DataFrame) -> DataFrame:
    """``query_id, words``: the distinct words of each query, sorted; rows of one id are one query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.unique(word_hashes(t).view(np.int64)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["query_id", "words"])

    found = queries.where("query_id is not null").select("query_id", "text").mapInArrow(work, "query_id long, words array<long>")
    return found.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))


@dataclass
class Block:
    """Queries that run together: their ids, their words as numbers of ``known``, and the least score that each still wants."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    least: np.ndarray

    @classmethod
    def gather(cls, part: DataFrame, df: DataFrame, n_docs: int) -> Block:
        """From ``part`` (query_id, words) and ``df`` (word, df); both are bounded by the size of a block."""
        rows = part.toArrow().combine_chunks()
        order = np.argsort(rows["query_id"].to_numpy(), kind="stable")
        lists = rows["words"].combine_chunks().take(pa.array(order))
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        counts = df.toArrow()
        known, d = counts["word"].to_numpy(), counts["df"].to_numpy().astype(np.float64)
        by_word = np.argsort(known)
        known, d = known[by_word], d[by_word]
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        keep = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        return cls(rows["query_id"].to_numpy()[order], np.append(0, np.cumsum(sizes)), at[keep].astype(np.int32), known, np.log(1 + (n_docs - d + 0.5) / (d + 0.5)), np.zeros(len(order)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(index: DataFrame, block: Block, mean: float, k: int) -> DataFrame:
    """``query_id, doc_id, score``: the k best of each shard of ``index`` that may be among the k best of all."""
    held = index.sparkSession.sparkContext.broadcast(block)  # bounded by QUERY_WORDS and QUERIES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        asked = Asked(len(block.known), block.first, block.words)
        best, least = np.zeros((len(block.ids), k)), block.least.copy()  # the k best scores that this task has seen
        for shard in _one_shard_at_a_time(batches, 0):
            if len(shard.words):
                query, docs, scores = shard.search_all(shard.ready(mean, block.known, block.weights), asked, k, best, least)
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[query].astype(np.int64)), pa.array(docs.astype(np.int64)), pa.array(scores)], ["query_id", "doc_id", "score"])

    return index.select("shard").mapInArrow(work, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k documents of ``docs`` (doc_id, text) with the best BM25 score for each of ``queries`` (query_id, text).

    A query's words count once.  idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    Ties go to the smaller doc_id.  Documents that share no word with the query
    aren't results, so a null or wordless query has none, and neither has an
    empty table.  Rows without an id are neither indexed nor asked; repeated
    rows of ``docs`` are documents of their own.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared_dir(spark)  # names the folder that checkpoint() writes to, if nothing has yet
    index = build_index(docs).checkpoint()  # read back row by row: a columnar reader would hold all shards of a file at once
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    mean = total.words / total.n if total.n else 0.0
    asked = stored(_query_words(queries).where(F.size("words") > 0), "queries")
    words = asked.select(F.explode("words").alias("word")).distinct()
    df = stored(_frequencies(index, words), "frequencies")
    # blocks of queries by hash buckets of ids, so that each fits a worker; one is on the driver at a time
    size = asked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("w"), F.count("*").alias("q")).first()
    blocks = max(1, -(-size.w // QUERY_WORDS), -(-size.q // QUERIES))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    path, schema = new_path(spark, "found"), "query_id long, doc_id long, score double"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        part = dealt.where(F.col("part") == b).drop("part")
        block = Block.gather(part, df if blocks == 1 else df.join(part.select(F.explode("words").alias("word")).distinct(), "word", "left_semi"), total.n)
        first = stored(_ranked(_searched(index.where("wave = 0"), block, mean, k), k), "first_wave")
        for r in first.where(F.col("rank") == k).select("query_id", "score").toLocalIterator():  # at most the queries of the block
            block.least[np.searchsorted(block.ids, r.query_id)] = r.score
        both = first.drop("rank").unionByName(_searched(index.where("wave > 0"), block, mean, k))
        both.write.mode("append").parquet(path)
    return _ranked(spark.read.schema(schema).parquet(path), k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


#: ``op7_block_max_search`` in SQL; scores are rounded there and here.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM documents
), counts AS (
  SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL
), lengths AS (
  SELECT d.doc_id, coalesce(sum(n), 0) AS len FROM documents d LEFT JOIN counts USING (doc_id) GROUP BY ALL
), stats AS (
  SELECT count(*) AS n_docs, sum(len) / count(*) AS mean FROM lengths
), df AS (
  SELECT word, count(*) AS df FROM counts GROUP BY ALL
), scored AS (
  SELECT q.doc_id AS query_id, c.doc_id,
    sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * c.n * 2.2 / (c.n + 1.2 * (0.25 + 0.75 * len / mean))) AS score
  FROM counts q JOIN counts c USING (word) JOIN df USING (word) JOIN lengths l ON l.doc_id = c.doc_id, stats
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""
