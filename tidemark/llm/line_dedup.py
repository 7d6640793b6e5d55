"""Line dedup by DataFrame functions alone, with hashes ranged over the partitions and one sorted stream in each.

Texts are cut once: each line gives the 128-bit hash of its key, its document and its position. These rows are partitioned by ranges of
(hash, document) and sorted by (hash, document, position), so a key that a third of all documents hold fills partitions of its own instead of one
task. Each partition is a stream in which a document's first line of a key is told from its later ones, and which folds a key to
its number of documents and its first line. A key that lies inside one partition is settled there; only the least and the greatest key of
each partition may go on in another, and only these are added up over partitions. The lines to drop are found among the same rows,
partition by partition, and go back to the texts as bitmaps: one 64-bit word for each 64 lines, with only the words that drop something.
With ``keep_first`` the first line of each frequent key (least doc_id, nulls last, then least text hash, then position) stays.

Defined results: null or empty text is one empty line; a line's key is the line stripped of ASCII white space with A-Z
lower-cased; keys under ``min_chars`` code points never count; repeated rows count as documents of their own and get
equal bitmaps; an empty table gives an empty table; extra columns are ignored (``apply`` returns them unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, lower_ascii, materialise, parts

MIN_DOCS = 10
MIN_CHARS = 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hashed(k: Column) -> list[Column]:
    """Two hashes of which neither follows from the other: the second is seeded by a literal's."""
    return [F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")]


def dealt_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, th (hash of the text), pos, opens (first line of its key in its document), part (its range); sorted, on disk."""
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(lines(F.col("text")), key)).alias("pos", "k")).filter(F.length("k") >= min_chars)
    cut = materialise(each.select(*_hashed(F.col("k")), "doc_id", "th", "pos"), "lines")
    of_doc = ["h1", "h2", "doc_id", "th"]
    ranged = cut.repartitionByRange(parts(docs.sparkSession), *of_doc).sortWithinPartitions(*of_doc, "pos")
    # equal rows are lines of repeated documents, each of which opens: rank, not row number
    opens = F.rank().over(Window.partitionBy(*of_doc).orderBy("pos")) == 1
    return materialise(ranged.withColumn("opens", opens).withColumn("part", F.spark_partition_id()), "dealt")


def frequent_keys(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Of ``dealt_lines``: h1, h2, part, first (null ids last), n_docs of the keys found in at least min_docs documents; a row for each range a key lies in."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos")
    folded = rows.groupBy("h1", "h2", "part").agg(F.count_if("opens").alias("n"), F.min(place).alias("at"))
    edges = rows.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))  # a row for each partition
    this = F.struct("h1", "h2")
    open_ = folded.join(F.broadcast(edges), "part").filter((F.col("n") >= min_docs) | (this == F.col("low")) | (this == F.col("high")))
    over = Window.partitionBy("h1", "h2")
    settled = open_.select("h1", "h2", "part", F.min("at").over(over).alias("first"), F.sum("n").over(over).alias("n_docs"))
    return settled.filter(F.col("n_docs") >= min_docs)


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), words map<int,long>: bit i of word w is 1 if line 64 w + i goes; documents that lose nothing have no row."""
    rows = dealt_lines(docs.select("doc_id", "text"), min_chars)
    gone = rows.join(frequent_keys(rows, min_docs), ["h1", "h2", "part"])
    if keep_first:
        gone = gone.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))))
    bit = F.expr("shiftleft(1L, pos % 64)")
    word = gone.groupBy("doc_id", "th", F.expr("cast(pos div 64 as int)").alias("w")).agg(F.bit_or(bit).alias("bits"))
    return word.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("words"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """The documents with ``__tm_kept`` (text of the other lines, joined by \\n), ``__tm_lines``, ``__tm_dropped`` added."""
    maps = drop_bitmaps(docs, min_docs, min_chars, keep_first).select(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th"), F.col("words").alias("__tm_words"))
    both = docs.join(maps, docs["doc_id"].eqNullSafe(maps["__tm_id"]) & (F.xxhash64(docs["text"]) == maps["__tm_th"]), "left")
    each = lines(F.col("text"))
    dense = F.transform(F.sequence(F.lit(0), F.expr("cast((__tm_lines - 1) div 64 as int)")), lambda w: F.coalesce(F.try_element_at(F.col("__tm_words"), w), F.lit(0).cast("long")))
    bit_set = lambda i: F.getbit(F.get(F.col("__tm_dense"), (i / 64).cast("int")), i % 64) == 1
    both = both.withColumn("__tm_lines", F.size(each).cast("long")).withColumn("__tm_dense", F.when(F.col("__tm_words").isNotNull(), dense))
    kept = F.when(F.col("__tm_words").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.filter(each, lambda _, i: ~bit_set(i)), "\n"))
    dropped = F.coalesce(F.aggregate(F.map_values("__tm_words"), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x)), F.lit(0).cast("long"))
    return both.withColumn("__tm_kept", kept).withColumn("__tm_dropped", dropped).drop("__tm_id", "__tm_th", "__tm_words", "__tm_dense")


def apply(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """The documents' own columns with text (and n_chars, if there) as they are after dropping; other rows and columns unchanged."""
    out = line_dedup(docs, min_docs, min_chars, keep_first)
    text = F.when(F.col("__tm_dropped") > 0, F.col("__tm_kept")).otherwise(F.col("text"))
    return out.select(*[(text.alias(c) if c == "text" else F.when(F.col("__tm_dropped") > 0, F.length("__tm_kept")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])
