"""Trigram index for text search over large tables.

A posting says that a text column of a row holds three letters in a row (lower-cased). Postings
lie in hash buckets of their letters, sorted within a file, so that a search lists a few folders
and reads a few row groups. Each word of a search is looked up by its rarest trigrams; rows that
have them all in one column are the candidates, and the exact search decides among them. The
result is that of ``reports.search`` over the indexed rows:

* a word shorter than three letters has no trigram: it narrows nothing and is checked exactly;
* a search of such words only reads the table;
* blank and null texts have no postings and hold no word;
* a row added twice is found once; after a changed text the row is added again, the old postings
  then are candidates that the exact search refuses.

Rows are added batch by batch. A batch counts once its trigram counts, written last, are
complete; one that was stopped is added again under its name and replaces what it left.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.operators import reports
from custody.session import spread

GRAM = 3
# Trigrams looked up for a word, and words looked up in a search: their product fits the bits of a
# BIGINT. Further words are checked exactly only.
PROBES, WORDS = 3, 20

_EVERY_GRAM = "(?s)(?=(" + "." * GRAM + "))"


def trigrams(text: Column) -> Column:
    """Distinct runs of three letters of a text, lower-cased; none for shorter or null texts."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_EVERY_GRAM), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


class SearchIndex:
    """Index over the text columns of a table with a unique id, in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, id_column: str, text_columns: list[str],
                 id_type: str = "BIGINT", buckets: int = 64):
        self.spark = spark
        self.root = root.rstrip("/")
        self.id_column = id_column
        self.text_columns = list(text_columns)
        self.buckets = buckets
        self._posting = f"field STRING, gram STRING, id {id_type}, batch STRING, bucket INT"
        self._count = "gram STRING, places BIGINT, batch STRING"

    # --- writing ---

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Index rows under a batch name; the same name again replaces the batch.

        ``rows`` is read twice: they are counted and dealt evenly, since the texts of a whole
        table may lie in one split.
        """
        fields = F.array(
            *[F.struct(F.lit(c).alias("field"), trigrams(F.col(c)).alias("grams")) for c in self.text_columns]
        )
        needed = list(dict.fromkeys([self.id_column, *self.text_columns]))
        postings = (
            spread(rows.where(F.col(self.id_column).isNotNull()).select(*needed))
            .select(F.col(self.id_column).alias("id"), F.explode(fields).alias("f"))
            .select("f.field", F.explode("f.grams").alias("gram"), "id")
            .withColumn("bucket", self._bucket(F.col("gram")))
        )
        # A frequent trigram makes a large bucket: rebalancing splits it over several tasks.
        laid_out = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "id")
        fs, counted = self._fs(f"{self.root}/grams/batch={batch}")
        fs.delete(counted, True)  # a batch that is being replaced counts again once it is whole
        path = f"{self.root}/postings/batch={batch}"
        laid_out.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema("field STRING, gram STRING, bucket INT").parquet(path)
        counts = written.groupBy("gram").agg(F.count(F.lit(1)).alias("places"))
        counts.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.root}/grams/batch={batch}")

    # --- reading ---

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Names of the batches that were added whole."""
        fs, folder = self._fs(f"{self.root}/grams")
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        whole = [p for p in found if fs.exists(self._fs(f"{p.toString()}/_SUCCESS")[1])]
        return sorted(p.getName().removeprefix("batch=") for p in whole)

    def _read(self, name: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return rows.parquet(*[f"{self.root}/{name}/batch={b}" for b in batches])

    def probes(self, text: str) -> dict[str, list[str]] | None:
        """Rarest trigrams of each word to look up; None if a trigram is in no row.

        At most the trigrams of the search text reach the driver.
        """
        words = sorted(set((text or "").split()))
        if not words:
            return {}
        grams = (
            self.spark.createDataFrame([(w,) for w in words], "word STRING")
            .select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
        )
        wanted = [(r.word, r.gram) for r in grams.collect()]
        asked = sorted({g for _, g in wanted})
        stored = self._read("grams", self._count, self.batches()).where(F.col("gram").isin(asked))
        places = {r.gram: r.n for r in stored.groupBy("gram").agg(F.sum("places").alias("n")).collect()}
        if any(g not in places for g in asked):
            return None
        of_word = defaultdict(list)
        for word, gram in wanted:
            of_word[word].append(gram)
        rarest = {w: sorted(gs, key=lambda g: (places[g], g))[:PROBES] for w, gs in of_word.items()}
        kept = sorted(rarest, key=lambda w: (min(places[g] for g in rarest[w]), w))[:WORDS]
        return {w: rarest[w] for w in kept}

    def candidates(self, probes: dict[str, list[str]]) -> DataFrame:
        """Ids of rows that hold every word's probes in one of their columns.

        Rows meet by id, never by trigram, and are combined in each task before they move.
        """
        grams = sorted({g for gs in probes.values() for g in gs})
        bit = {g: 1 << i for i, g in enumerate(grams)}
        folders = sorted(
            r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram STRING")
            .select(self._bucket(F.col("gram"))).distinct().collect()
        )
        near = self._read("postings", self._posting, self.batches()).where(
            F.col("bucket").isin(folders) & F.col("gram").isin(grams)
        )
        flag = F.element_at(F.create_map(*[F.lit(x) for g in grams for x in (g, bit[g])]), F.col("gram"))
        seen = near.groupBy("id", "field").agg(F.bit_or(flag.cast("bigint")).alias("seen"))
        need = [sum(bit[g] for g in gs) for gs in probes.values()]
        held = [F.bool_or(F.col("seen").bitwiseAND(F.lit(n)) == n).alias(f"w{i}") for i, n in enumerate(need)]
        both = reduce(lambda a, b: a & b, [F.col(f"w{i}") for i in range(len(need))])
        return seen.groupBy("id").agg(*held).where(both).select(F.col("id").alias(self.id_column))

    def search(self, rows: DataFrame, text: str, facets: dict[str, list] | None = None) -> DataFrame:
        """Rows of the indexed table that pass the facets and hold every word of the text."""
        probes = self.probes(text)
        if probes is None:
            return rows.where(F.lit(False))
        exact = reports.search(rows, facets, text, self.text_columns)
        return exact.join(self.candidates(probes), self.id_column, "left_semi") if probes else exact
