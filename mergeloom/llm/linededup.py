"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, keeper): the 128-bit hash of a line's key,
in how many documents of the run it stands, and the largest doc_id holding it.
Runs are sorted by the hash and share one bucketing by it, so joining and
merging them moves no rows.  Batches of documents come in falling order of
doc_id.  Each new batch is merge-joined with the runs: keys that these have
settled, as found in enough documents, have their keeper already and leave it;
the others are added as a run of level 0.  When a level holds ``fanout`` runs,
they are compacted into one run of the next level.  Lines of settled keys then
leave all documents but the keeper's.

Everything is DataFrame code.  Lines that over 1/``heavy_share`` of a batch's
(line, document) pairs hold are handled apart: there are fewer than heavy_share
of them in a batch, few enough to broadcast, and no other key has more than that
share of the rows of the shuffled join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.runtime import new_path, remove, trim_driver, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\f\r"
#: Stands for a doc_id of null, which sorts before all others.
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line, stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


KEY = ["h1", "h2"]


class LineRuns:
    """The levelled runs of one dedup, as bucketed tables whose files are in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, buckets: int = 8, fanout: int = 2):
        self.spark, self.min_docs, self.buckets, self.fanout = spark, min_docs, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self._paths: dict[str, str] = {}

    def _save(self, rows: DataFrame) -> str:
        """rows as a table of its own, one sorted file a bucket if they come bucketed."""
        path = new_path(self.spark, "run")
        name = f"spark_catalog.default.run_{path[-12:]}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        self._paths[name] = path
        trim_driver(self.spark)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs merged: joins of tables of one bucketing, which move no rows of the first two."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnsRenamed({"n_docs": "more", "keeper": "other"})
            rows = rows.join(other.hint("merge"), KEY, "full_outer").select(
                *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "other").alias("keeper")
            )
        return rows

    def _unsettled(self, batch: str) -> DataFrame:
        """Rows of a batch but those whose keys stand in enough documents of the runs."""
        rows, seen = self.spark.table(batch), F.lit(0)
        for i, name in enumerate(self._runs()):
            run = self.spark.table(name).select(*KEY, F.col("n_docs").alias(f"n{i}"))
            rows, seen = rows.join(run.hint("merge"), KEY, "left"), seen + F.coalesce(f"n{i}", F.lit(0))
        return rows.where(seen < self.min_docs).select(*KEY, "n_docs", "keeper")

    def _runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame, heavy_share: int) -> DataFrame:
        """Add a batch: (h1, h2, doc), one row per document and key, all documents before those added so far.

        Gives (h1, h2) of the keys that over 1/heavy_share of the rows hold.
        """
        keys = lines.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        batch = self._save(keys.repartition(self.buckets, *KEY))
        rows = self.spark.table(batch)
        total = rows.agg(F.sum("n_docs")).first()[0] or 0
        heavy = written(rows.where(F.col("n_docs") * heavy_share > total).select(*KEY), "heavy")
        own = batch
        if self._runs():
            own = self._save(self._unsettled(batch))
            self._drop(batch)
        self.levels[0].append(own)
        for level, held in enumerate(self.levels):
            if len(held) >= self.fanout:
                self._compact(held, level + 1)
                held.clear()
        return heavy

    def _compact(self, names: list[str], level: int) -> None:
        merged = self._save(self._merged(names))
        for name in names:
            self._drop(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(merged)

    def settled(self) -> DataFrame:
        """(h1, h2, keeper) of every key found in enough documents; the runs are compacted into one and kept no longer."""
        runs = self._runs()
        out = written(self._merged(runs).where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper"), "settled")
        for name in runs:
            self._drop(name)
        self.levels = [[]]
        return out


def surplus_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, heavy_share: int = 1024, bucket_rows: int = 1 << 22
) -> DataFrame:
    """(doc, text_hash, positions): the lines that each text loses; texts that lose none are left out.

    A document is a doc_id; rows without one hold no document, and lose nothing.
    A bucket of the runs has about ``bucket_rows`` keys of a batch at most.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull())
    first, last = known.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    first, last = first or 0.0, last or 0.0
    line = known.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"),
    ).where(F.octet_length("line") >= min_chars)
    keyed = line.select("doc", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # Later batches hold smaller ids: no id is in two, however it rounds.
    batch = F.floor((F.lit(last) - F.col("doc").cast("double")) / F.lit((last - first) * (1 + 1e-9) + 1) * batches).cast("int")
    held = (
        keyed.select("doc", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        .groupBy("doc", "text_hash", *KEY)
        .agg(F.collect_set("at").alias("positions"))  # of one text
        .withColumn("batch", F.least(F.lit(batches - 1), batch))
    )
    held = written(held, "lines", partition_by=["batch"])
    runs = LineRuns(spark, min_docs, max(8, -(-held.count() // (batches * bucket_rows))), fanout)
    heavy = [runs.add(held.where(F.col("batch") == i).select(*KEY, "doc").distinct(), heavy_share) for i in range(batches)]
    heavy = reduce(DataFrame.union, heavy).distinct()  # fewer than batches x heavy_share keys
    often = runs.settled()
    held = held.select("doc", "text_hash", *KEY, "positions")
    by_broadcast = held.join(F.broadcast(often.join(F.broadcast(heavy), KEY)), KEY)
    by_merge = held.join(F.broadcast(heavy), KEY, "left_anti").join(often.hint("merge"), KEY)
    lost = by_broadcast.unionByName(by_merge).where(F.col("doc") < F.col("keeper"))
    return lost.groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("positions")).alias("positions"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without the lines it loses) added.

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except in the largest doc_id holding them.

    A text that is null or empty has one empty line, and kept is then empty.
    Texts of any length are split whole.  Shorter keys are never dropped.  Rows
    of one doc_id, with one text or several, are one document: it is counted
    once, and all or none of them lose a line.  A row without doc_id is not
    counted and loses nothing.  Other columns, whatever their names, pass
    unchanged (n_lines, n_dropped and kept replace columns so named).  An empty
    table gives an empty table.
    """
    base = docs.drop("n_lines", "n_dropped", "kept")
    lost = surplus_lines(base.select("doc_id", "text"), **options).select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("positions").alias("__lost")
    )
    joined = base.withColumns({"__doc": F.coalesce("doc_id", F.lit(NO_ID)), "__hash": F.xxhash64("text")}).join(
        lost, ["__doc", "__hash"], "left"
    )
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col("__lines")[i]), "\n")
    )
    return (
        joined.withColumn("__lines", lines)
        .withColumns({
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"),
            "kept": kept,
        })
        .drop("__doc", "__hash", "__lost", "__lines")
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_KEY = r"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

DEDUP_SQL = f"""
WITH line AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{source}})
), keyed AS (SELECT rid, doc_id, line, pos, {_KEY} AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(k.doc_id < o.keeper, false) AS lost FROM keyed k LEFT JOIN often o ON k.key = o.key
), deduped AS (
  SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '') AS kept
  FROM marked GROUP BY rid, doc_id)
"""
SQL = DEDUP_SQL.format(source="documents") + "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
