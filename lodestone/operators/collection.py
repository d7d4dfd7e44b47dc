"""A searchable collection that documents are ingested into: chunks with vectors, and an inverted index kept up to date.

Each ingest is one batch of a :class:`Ledger`: chunks, vectors, postings, term counters and totals count together or not at
all. Postings are stored by a hash of their term, so a query reads the folders of its own terms; how many chunks have a term, and the
collection's totals, are sums of what batches added and took away, so neither is counted again. A document that comes again
with another text marks its old rows dead: they are left out on reading, and gone after :meth:`Collection.compact`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, retrieval
from lodestone.sources.corpus import first_of
from lodestone.sources.ledger import Ledger
from lodestone.sources.staging import dropped, staged

SCHEMAS = {
    "docs": "doc_id long, content string",
    "chunks": "chunk_id string, doc_id long, char_start int, char_end int, content string, strategy string, len int",
    "vectors": "chunk_id string, vector array<double>",
    "postings": "term string, doc_id long, char_start int, char_end int, len int, strategy string, tf long, bucket int",
    "counters": "term string, df long, bucket int",
    "totals": "units long, length long",
    "dead": "doc_id long, of long",
}
BUCKETS = 64
#: What a posting has of its chunk. Its id is worked out of these on reading: ids are as good as random, so written once for each term they were most of the index.
_PLACE = ("doc_id", "char_start", "char_end", "len", "strategy")
#: From (key, text) rows and the key's name to (key, vector); rows without a vector are left out.
Embedder = Callable[[DataFrame, str], DataFrame]


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each chunk: its distinct terms and how often it has each. A chunk is one row, so nothing is shuffled."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            terms = pc.list_flatten(part.column("tokens")).dictionary_encode()
            row = pc.list_parent_indices(part.column("tokens")).to_numpy().astype(np.int64)
            width = max(1, len(terms.dictionary))
            pairs, times = np.unique(row * width + terms.indices.to_numpy(), return_counts=True)
            of = pa.array(pairs // width)
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(pairs % width)), *(part.column(c).take(of) for c in _PLACE), pa.array(times.astype(np.int64))], ["term", *_PLACE, "tf"])


class Collection:
    def __init__(self, spark: SparkSession, path: str, chunker: str = "fixed", embedder: Embedder = retrieval.vectors_of, **how):
        self.ledger, self.chunker, self.embedder, self.how = Ledger(spark, path, SCHEMAS, {"postings": "bucket", "counters": "bucket"}), chunker, embedder, how

    def _live(self, table: str) -> DataFrame:
        """Rows of documents that no later batch replaced."""
        return self._but_dead(self.ledger.read(table))

    def _but_dead(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.ledger.read("dead").select("doc_id", F.col("of").alias("batch")), ["doc_id", "batch"], "left_anti")

    def docs(self) -> DataFrame:
        return self._live("docs")

    def chunks(self) -> DataFrame:
        return self._live("chunks").drop("batch")

    def vectors(self) -> DataFrame:
        """(chunk_id, vector) of live chunks."""
        return self._vectors().drop("batch")

    def _vectors(self) -> DataFrame:
        # a chunk of a replaced text may have the id of one that stayed: the batch tells them apart
        return self.ledger.read("vectors").join(self._live("chunks").select("chunk_id", "batch"), ["chunk_id", "batch"], "left_semi")

    def ingest(self, docs: DataFrame, batch: int) -> dict | None:
        """Bring in a batch of ``docs`` (doc_id, text); gives a report, or None where the batch was done before.

        A document that is there with the same text is left alone, one with another text is replaced, and one with null or empty
        text loses its chunks. Of several rows with one id in a batch, the first text in order counts; rows without an id are left out."""
        if self.ledger.done(batch):
            return None
        write = lambda table, rows: self.ledger.write(table, batch, rows)
        given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        one = first_of(given, "doc_id", "text").withColumn("content", F.sha2("text", 256))
        live = self.docs()
        fresh = staged(one.join(live.select("doc_id", "content"), ["doc_id", "content"], "left_anti"), "fresh")
        dead = write("dead", live.join(fresh.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("batch").alias("of")))
        new = write("docs", fresh)
        chunks = write("chunks", chunking.chunk(fresh.select("doc_id", "text"), self.chunker, **self.how).withColumn("len", F.size(tx.tokens(F.col("content")))))
        dropped(fresh)
        vectors = write("vectors", self.embedder(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id"))
        terms = chunks.select(*_PLACE, tx.tokens(F.col("content")).alias("tokens"))
        postings = write("postings", terms.mapInArrow(_counted, "term string, doc_id long, char_start int, char_end int, len int, strategy string, tf long").withColumn("bucket", bucket(F.col("term"))))
        gone = dead.select("doc_id", F.col("of").alias("batch"))
        old = self.ledger.read("postings").join(gone, ["doc_id", "batch"], "left_semi")
        counted = postings.select("term", F.lit(1).alias("n")).unionByName(old.select("term", F.lit(-1).alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
        write("counters", counted.where("df <> 0").withColumn("bucket", bucket(F.col("term"))))
        old_chunks = self.ledger.read("chunks").join(gone, ["doc_id", "batch"], "left_semi")
        lengths = chunks.select(F.lit(1).alias("n"), "len").unionByName(old_chunks.select(F.lit(-1).alias("n"), (-F.col("len")).alias("len")))
        whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        write("totals", lengths.agg(whole("n").alias("units"), whole("len").alias("length")))
        report = {"documents": given.select("doc_id").distinct().count(), "new": new.count(), "replaced": dead.select("doc_id").distinct().count(), "chunks": chunks.count(), "vectors": vectors.count(), "chunker": self.chunker}
        self.ledger.commit(batch, report)
        return report

    def reset(self) -> None:
        """Drop all documents: an empty base replaces what was there."""
        self._rebase(lambda table: self.ledger.spark.createDataFrame([], SCHEMAS[table]))

    def compact(self) -> None:
        """Write what is live as one base that replaces all batches so far; counters and totals become plain sums."""
        counters = self.ledger.read("counters").groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = self.ledger.read("totals").agg(F.sum("units").alias("units"), F.sum("length").alias("length"))
        rows = {"counters": counters, "totals": totals, "dead": self.ledger.spark.createDataFrame([], SCHEMAS["dead"]), "vectors": self._vectors()}
        self._rebase(lambda table: rows[table] if table in rows else self._live(table))

    def _rebase(self, rows: Callable[[str], DataFrame]) -> None:
        past = [b for b in self.ledger.batches()]
        if not past:
            return
        base = -1 - max(b if b >= 0 else -1 - b for b in past)
        if base in past:
            if len(past) == 1 and rows("docs").count() == self.docs().count():
                return
            raise ValueError("nothing was ingested since the last base")
        for table in SCHEMAS:
            self.ledger.write(table, base, rows(table))
        self.ledger.commit(base, {"base": True})
        self.ledger.sweep()

    def bm25(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """BM25 top-k (query_id, unit_id, score, rank) of the live chunks for ``queries`` (query_id, text). Only the folders of the
        queries' terms are read; equal to :func:`retrieval.bm25` over :meth:`chunks`."""
        terms = retrieval.query_terms(queries)
        totals = self.ledger.read("totals").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.sum("length"), F.sum("units")), F.lit(0.0)).alias("avg"))
        if (found := retrieval.few_weights(terms)) is not None:
            words, asked = found
            codes = self.ledger.spark.createDataFrame(list(enumerate(words)), "code int, term string").withColumn("bucket", bucket(F.col("term")))
            folders = [r["bucket"] for r in codes.select("bucket").distinct().collect()]  # BUCKETS at most
            here = lambda rows: rows.where(F.col("bucket").isin(folders)).join(F.broadcast(codes), ["term", "bucket"])
            df = {r["term"]: r["df"] for r in here(self.ledger.read("counters")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()}
            # postings are dealt once, by document, as numbers: there the dead are found and a chunk's terms brought together
            span, hit = "shiftleft(cast(char_start AS long), 32) | char_end", "shiftleft(tf, 32) | code"
            rows = here(self.ledger.read("postings")).select("doc_id", "batch", F.expr(span).alias("span"), "len", "strategy", F.expr(hit).alias("hit"))
            rows = self._but_dead(rows).groupBy("doc_id", "batch", "span", "len", "strategy").agg(F.collect_list("hit").alias("hits"))
            unit_id = tx.chunk_id(F.col("doc_id"), F.shiftright("span", 32), F.expr("span & 4294967295"), F.col("strategy")).alias("unit_id")
            units = rows.select(unit_id, "len", F.flatten(F.transform("hits", lambda h: F.array_repeat(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright(h, 32).cast("int")))).alias("hits"))
            return retrieval.multiplied(units, terms, df, asked, totals.first(), k, {t: i for i, t in enumerate(words)})
        unit_id = tx.chunk_id(F.col("doc_id"), F.col("char_start"), F.col("char_end"), F.col("strategy")).alias("unit_id")
        wanted = terms.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
        folders = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
        of_terms = lambda rows: rows.where(F.col("bucket").isin(folders)).join(wanted, ["term", "bucket"], "left_semi")
        postings = self._but_dead(of_terms(self.ledger.read("postings"))).select(unit_id, "len", "term", "tf")
        df = of_terms(self.ledger.read("counters")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return retrieval.score_postings(postings, df, totals, terms, k)

    def nearest(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Exact cosine top-k of the live chunks' vectors for ``queries`` (query_id, text)."""
        return retrieval.dense_top(self.vectors().withColumnRenamed("chunk_id", "unit_id"), self.embedder(queries.select("query_id", "text"), "query_id"), k)

    def health(self) -> DataFrame:
        """One row (documents, chunks, batches, chunker): live counts from the totals and the configuration."""
        spark = self.ledger.spark
        totals = self.ledger.read("totals").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("chunks"))
        docs = self.docs().agg(F.count("*").alias("documents"))
        return docs.crossJoin(totals).crossJoin(spark.createDataFrame([(len(self.ledger.batches()), self.chunker)], "batches long, chunker string"))  # one row each
