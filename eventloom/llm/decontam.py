"""Benchmark decontamination with a positional inverted index of the documents, in DataFrame operations.

The index stores, for each document and each term that the benchmark has, the rising list of the term's places. It is a table bucketed
by (document, term) and sorted, with delta-coded lists, so that a list is joined to where it lies: the index is written once and not
shuffled again, and the lists of a frequent term are spread over all buckets by document. Of each benchmark phrase the two rarest
terms, by the counts that the index itself gives, are sought: their lists, each shifted by the term's offset in the item, are
intersected. What is left are the places at which the item may lie; there the lists of its other terms are intersected in the same
way, and runs of neighbouring offsets that all hold are occurrences of phrases. proximity() asks the same lists for terms near each
other.

What is broadcast (terms and items of the benchmark) is checked against broadcast_bytes first; a larger benchmark is joined by
shuffle, in which lists move to their term.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, forget, shared_dir, written

#: What separates words, in lower-cased texts.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCUMENT = ["doc", "th"]


def words(text) -> F.Column:
    """The words of a text, in order; null: none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def document_key(doc_id: str, text: str) -> list[F.Column]:
    """(doc, th): the id as a string that also tells null apart, and a hash of the text, as rows may share an id."""
    return [F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("th")]


class Index:
    """Items of a benchmark, and the places of their terms in documents."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, *, text: str, doc_id: str, item_id: str, item_text: str, phrase: int, broadcast_bytes: int):
        self.phrase, self.spark = phrase, docs.sparkSession
        items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("terms")).where("size(terms) > 0")
        # items that read alike are one item of the index; its number is its place in the table that is written
        self.items = written(items.groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.monotonically_increasing_id().alias("i"), "terms", "items", F.size("terms").alias("n")), "items")
        size = self.items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("terms", " ")) + 16 * F.col("n")), F.lit(0))).first()[0]
        self.fits = size <= broadcast_bytes
        vocabulary = self.items.select(F.explode("terms").alias("term")).distinct()
        tokens = docs.select(*document_key(doc_id, text), F.posexplode(words(F.col(text))).alias("p", "term"))
        lists = tokens.join(self._small(vocabulary), "term").groupBy(*DOCUMENT, "term").agg(F.array_sort(F.array_distinct(F.collect_list("p"))).alias("at"))
        self._name, self._path = f"postings_{uuid.uuid4().hex}", f"{shared_dir(self.spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
        buckets, keys = int(self.spark.conf.get("spark.sql.shuffle.partitions")), [*DOCUMENT, "term"]
        lists.write.format("parquet").option("path", self._path).option("parquet.writer.version", "PARQUET_2_0").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(self._name)
        self.postings = self.spark.table(self._name)
        counts = self.postings.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
        places = self.items.select("i", "n", F.posexplode("terms").alias("q", "term")).join(counts, "term")
        # the phrases that start at 0..n - phrase (one, if the item is shorter) and have offset q in them
        starts = F.sequence(F.greatest(F.lit(0), F.col("q") - (phrase - 1)), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n") - phrase)))
        ranked = places.select("i", "q", "term", F.explode(starts).alias("b"), "df", "n")
        # a phrase with a term that no document has cannot occur: `counts` lacks that term, so fewer offsets are left
        of_phrase = Window.partitionBy("i", "b")
        ranked = ranked.withColumn("left", F.count(F.lit(1)).over(of_phrase)).where(F.col("left") == F.least(F.col("n"), F.lit(phrase)))
        best = ranked.withColumn("k", F.row_number().over(of_phrase.orderBy("df", "q"))).where("k <= 2").groupBy("i", "b", "n").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("term", "q")])
        # a phrase of one word has no second term and takes the first again
        self.seeds = written(best.select("i", "b", "n", "term1", "q1", F.coalesce("term2", "term1").alias("term2"), F.coalesce("q2", "q1").alias("q2")), "seeds")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.fits else df

    def _lists(self, rows: DataFrame, term: str, name: str) -> DataFrame:
        """rows(doc, th, term, ...) with the list of that term in that document as `name`; without it, the row goes."""
        own = self.postings.select(*[F.col(c).alias(f"_{c}") for c in (*DOCUMENT, "term")], F.col("at").alias(name))
        return rows.join(own, (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th")) & (F.col(term) == F.col("_term"))).drop("_doc", "_th", "_term")

    def starts(self) -> DataFrame:
        """(doc, th, i, starts): where item i may start in a document, by the two rarest terms of some phrase."""
        seeds = self.seeds.select("i", "term1", "q1", "term2", "q2").distinct()
        one = self.postings.join(self._small(seeds), F.col("term") == F.col("term1")).select(*DOCUMENT, "i", "term2", "q2", F.transform("at", lambda p: p - F.col("q1")).alias("one"))
        both = self._lists(one, "term2", "at").select(*DOCUMENT, "i", F.array_intersect("one", F.transform("at", lambda p: p - F.col("q2"))).alias("s")).where(F.size("s") > 0)
        return both.groupBy(*DOCUMENT, "i").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))

    def occurrences(self) -> DataFrame:
        """(doc, th, i, first, end): runs of words of a document that are words of item i in order, a phrase long at least; a phrase
        is `phrase` words, or all of a shorter item."""
        terms = self.items.select("i", "n", F.posexplode("terms").alias("q", "term"))
        asked = self.starts().join(self._small(terms), "i")
        held = self._lists(asked, "term", "at").select(*DOCUMENT, "i", "n", "q", F.explode(F.array_intersect("starts", F.transform("at", lambda p: p - F.col("q")))).alias("start"))
        lie = Window.partitionBy(*DOCUMENT, "i", "start").orderBy("q")  # the offsets of an item
        runs = held.withColumn("run", F.col("q") - F.row_number().over(lie)).groupBy(*DOCUMENT, "i", "n", "start", "run").agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("length"))
        long = runs.where(F.col("length") >= F.least(F.col("n"), F.lit(self.phrase)))
        return long.select(*DOCUMENT, "i", (F.col("start") + F.col("q")).cast("long").alias("first"), (F.col("start") + F.col("q") + F.col("length")).cast("long").alias("end"))

    def close(self) -> None:
        """Removes the index and its catalogue entry."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        forget(self.seeds)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", phrase: int = 13, share: int = 20, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_hit, items (the item ids whose phrases occur, sorted as strings) and contaminated.

    A phrase is `phrase` consecutive words of an item, or all of a shorter item. A word is hit if a phrase occurs over it; a
    document is contaminated if it has hits and share * n_hit >= n_words.

    Defined cases: null and blank texts have no words and are clean; items without words are ignored, equal items are all
    reported; a null item_id is never reported but its text counts; rows that share a doc_id are judged row by row; an empty
    table of either kind gives no hits; columns of docs named as the new ones give way, all others pass through.
    """
    index = Index(docs, benchmark, text=text, doc_id=doc_id, item_id=item_id, item_text=item_text, phrase=phrase, broadcast_bytes=broadcast_bytes)
    spans = written(index.occurrences(), "occurrences")
    hits = spans.select(*DOCUMENT, F.explode(F.sequence("first", F.col("end") - 1)).alias("p")).distinct().groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n_hit"))
    whose = spans.select(*DOCUMENT, "i").distinct().join(index._small(index.items.select("i", "items")), "i").groupBy(*DOCUMENT).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = written(hits.join(whose, DOCUMENT), "contaminated")
    index.close()
    for table in (spans, index.items):
        forget(table)
    new = ("n_words", "n_hit", "items", "contaminated")
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in new])
    names = [f"c{k}" for k in range(len(base.columns))]
    rows = base.select(*[base[f"`{c}`"].alias(n) for c, n in zip(base.columns, names, strict=True)], *document_key(doc_id, text), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = rows.join(found, DOCUMENT, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(base.columns, names, strict=True)], "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, *, slop: int = 4, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", phrase: int = 13, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, items, first, last): phrases whose rarest term occurs in a document with all their other terms, repeats counted
    once, within `slop` words of where the exact phrase would end and begin; first and last bound the words searched.

    Defined cases: texts and items without words have no phrases; of empty tables, no rows; rows that share a doc_id are searched
    one by one, equal results come once."""
    index = Index(docs, benchmark, text=text, doc_id=doc_id, item_id=item_id, item_text=item_text, phrase=phrase, broadcast_bytes=broadcast_bytes)
    length = F.least(F.col("n"), F.lit(phrase))
    phrases = index.seeds.join(index.items.select("i", "terms", "items"), "i").select("i", "b", "term1", "q1", "items", length.alias("length"), F.array_distinct(F.slice("terms", F.col("b") + 1, length)).alias("needs"))
    at = index.postings.join(index._small(phrases), F.col("term") == F.col("term1")).select(*DOCUMENT, "i", "b", "items", "length", "needs", F.explode("at").alias("p"), "q1")
    ids = docs.select(*document_key(doc_id, text), F.col(doc_id).alias("own_id"), F.size(words(F.col(text))).alias("size"))
    begin = F.col("p") - F.col("q1") + F.col("b")
    near = at.join(ids, DOCUMENT).withColumns({"first": F.greatest(F.lit(0), begin - slop), "last": F.least(F.col("size"), begin + F.col("length") + slop)}).where("last > first")
    asked = near.select(*DOCUMENT, "i", "b", "own_id", "items", "first", "last", F.size("needs").alias("all"), F.explode("needs").alias("need")).distinct()
    held = index._lists(asked, "need", "places").where(F.exists("places", lambda p: (p >= F.col("first")) & (p < F.col("last"))))
    met = held.groupBy(*DOCUMENT, "i", "b", "own_id", "items", "first", "last", "all").agg(F.count(F.lit(1)).alias("n")).where("n = all")
    found = written(met.select(F.col("own_id").alias("doc_id"), "items", "first", "last").distinct(), "near")
    index.close()
    return found
