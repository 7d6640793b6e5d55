"""Entity resolution, event dedup, vector matching and ranked text search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.dedup import as_facts, dedup_events  # noqa: F401


def resolve_entities(mentions: DataFrame, companies: DataFrame, col: str) -> DataFrame:
    """The company of each mention by domain, then name in any case, then alias to the letter, then slug; the first that hits, else NULL.

    companies: id, name, slug, and canonical_domain and aliases if there. The four spellings of a mention meet those of the companies by kind and key in joins on keys that
    are unique on one side; the distinct mentions are looked up, then join their rows. Spellings are mostly distinct, so they are dealt out before they are gathered, and nothing is broadcast: a
    task holds its share of them only.
    """
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.expr("CAST(array() AS array<string>)")
    own = lambda c, other: F.col(c) if c in companies.columns else other
    spelt = F.concat(F.array(_keyed(0, own("canonical_domain", F.lit(None))), _keyed(1, F.lower("name")), _keyed(3, F.col("slug"))), F.transform(F.coalesce(own("aliases", none), none), lambda a: _keyed(2, a)))
    keys = companies.select("id", F.explode(spelt).alias("k")).filter("k.key is not null and k.key != ''").repartition(n, "k").groupBy("k").agg(F.min("id").alias("company_id"))
    t = T.strip(F.col(col))
    asked = mentions.select(F.col(col)).filter(t != "").repartition(n, col).distinct()
    ways = F.array(_keyed(0, F.nullif(T.normalize_domain(t), F.lit(""))), _keyed(1, F.lower(t)), _keyed(2, t), _keyed(3, T.slugify(t, fold=True)))
    best = asked.select(F.col(col).alias("__tm_m"), F.explode(ways).alias("k")).join(keys.hint("merge"), "k").groupBy("__tm_m").agg(F.min_by("company_id", "k.rank").alias("__tm_c"))
    return mentions.join(best.hint("merge"), F.col(col) == F.col("__tm_m"), "left").select(*[c for c in mentions.columns if c != "company_id"], F.col("__tm_c").alias("company_id"))


def _keyed(rank: int, key: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), key.cast("string").alias("key"))


def dedup_candidates(new: DataFrame, existing: DataFrame, days: int = 14) -> DataFrame:
    """Pairs of one company and type whose times lie within ``days``: an equi-join on day buckets, then the exact range."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (86_400_000_000 * days))
    a = new.select(F.col("id").alias("id_a"), "company_id", "event_type", F.col("observed_at").alias("t_a"), F.explode(F.array(bucket("observed_at") - 1, bucket("observed_at"), bucket("observed_at") + 1)).alias("bucket"))
    b = existing.select(F.col("id").alias("id_b"), "company_id", "event_type", F.col("observed_at").alias("t_b"), bucket("observed_at").alias("bucket"))
    gap = F.abs(F.unix_micros(F.col("t_a").cast("timestamp")) - F.unix_micros(F.col("t_b").cast("timestamp")))
    return a.join(b, ["company_id", "event_type", "bucket"]).filter((F.col("id_b") < F.col("id_a")) & (gap <= days * 86_400_000_000)).select("id_a", "id_b", "company_id", "event_type")


BLOCK = 2048


def _blocked(df: DataFrame, label: str, key: str, name: str) -> DataFrame:
    """df with ``name``, the number of its row's block in its label, and ``of_name``, how many blocks the label has; a block has about BLOCK rows."""
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") / BLOCK).alias(f"of_{name}"))
    return df.join(sizes, label).withColumn(name, F.pmod(F.xxhash64(key), F.col(f"of_{name}")))


def paired_blocks(queries: DataFrame, items: DataFrame) -> tuple[GroupedData, GroupedData]:
    """Both tables by (label, block of items, block of queries), to be cogrouped: each row goes to every block of the other side that its label has."""
    q, i = _blocked(queries, "label", "query_id", "block"), _blocked(items, "label", "item_id", "part")
    sizes = lambda df, n: df.select("label", f"of_{n}").distinct()
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"of_{n}") - 1)).alias(n)
    q_rest, i_rest = [c for c in queries.columns if c != "label"], [c for c in items.columns if c != "label"]
    both = q.drop("of_block").join(sizes(i, "part"), "label").select("label", "block", spread("part"), *q_rest)
    held = i.drop("of_part").join(sizes(q, "block"), "label").select(F.col("label").alias("i_label"), F.col("part").alias("i_part"), spread("block"), *i_rest).withColumnRenamed("block", "i_block")
    key = ["label", "part", "block"]  # two names for each, as both sides may come of one table
    return both.groupBy(*key), held.groupBy(*[f"i_{c}" for c in key])


def vector_topk(queries: DataFrame, items: DataFrame, k: int, min_similarity: float | None = 0.55) -> DataFrame:
    """query_id, item_id, similarity: the k best items of each query within its label; none below min_similarity unless that is None or not above 0.

    queries: query_id, q, label; items: item_id, v, label. Both are cut into blocks of bounded size by their counts, and each pair of blocks of one label is
    a group of its own, so a label that holds a third of all items is as many groups as its size asks for. numpy multiplies a pair of blocks at once and keeps k for each query.
    Null and zero vectors match nothing; ties go to the lesser item_id.
    """
    q, i = paired_blocks(queries.filter("q is not null").select("query_id", "q", "label"), items.filter("v is not null").select("item_id", "v", "label"))

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        a, b = np.array(qs["q"].tolist(), float), np.array(vs["v"].tolist(), float)
        norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        s = np.divide(a @ b.T, norm, out=np.full(norm.shape, -2.0), where=norm > 0)
        ids, out = vs["item_id"].to_numpy(), []
        for row, x in zip(s, qs["query_id"], strict=True):
            order = np.lexsort((ids, -row))[:k]
            order = order[row[order] > -2]
            out.append(pd.DataFrame({"query_id": x, "item_id": ids[order], "similarity": row[order]}))
        return pd.concat(out)

    rows = q.cogroup(i).applyInPandas(best, "query_id long, item_id long, similarity double")
    rows = rows.filter(F.col("similarity") >= min_similarity) if min_similarity is not None and min_similarity > 0 else rows
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def match_jobs(resumes: DataFrame, jobs: DataFrame, k: int = 20, min_similarity: float | None = 0.55, *, seniority: str | None = None, work_mode: str | None = None, search: Callable[..., DataFrame] = vector_topk) -> DataFrame:
    """resume_id, job_id, similarity, place: the k best active jobs of each résumé among those of its own role families.

    resumes: id, parsed_role_families, embedding; jobs: id, role_family, embedding, is_active, seniority, work_mode. A résumé without families is held against every family.
    ``search`` is ``vector_topk`` or ``vectors.vector_topk_pruned``.
    """
    fit = jobs.filter("is_active")
    for c, v in (("seniority", seniority), ("work_mode", work_mode)):
        fit = fit.filter(F.col(c) == v) if v is not None else fit
    families = fit.agg(F.collect_set(F.coalesce("role_family", F.lit("other"))).alias("labels"))  # one row
    none = F.size(F.coalesce("parsed_role_families", F.expr("CAST(array() AS array<string>)"))) == 0
    some = resumes.filter(~none).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.array_distinct("parsed_role_families")).alias("label"))
    every = resumes.filter(none).select(F.col("id").alias("query_id"), F.col("embedding").alias("q")).join(F.broadcast(families)).select("query_id", "q", F.explode("labels").alias("label"))
    items = fit.select(F.col("id").alias("item_id"), F.col("embedding").alias("v"), F.coalesce("role_family", F.lit("other")).alias("label"))
    found = search(some.unionByName(every), items, k, min_similarity)
    return found.select(F.col("query_id").alias("resume_id"), F.col("item_id").alias("job_id"), "similarity", "place")


# English words that a search passes over.
SEARCH_STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_WORD = "[^a-z0-9]+"


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = ["v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem)]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(stem))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(stem) > 2 and stem[-1] not in "aeiouwxy" and (stem[-2] in "aeiou" or stem[-2] == "y") and stem[-3] not in "aeiou"


# Suffixes of the published algorithm and what becomes of them.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(65_536)
def stem(word: str) -> str:
    """The stem of an English word in lower case, by Porter's published steps."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (cut := next((x for x in ("ed", "ing") if w.endswith(x)), None)) and _has_vowel(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        hit = max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]):
            w = w[: -len(hit[0])] + hit[1]
    hit = max((x for x in STEP_4 if w.endswith(x)), key=len, default=None)
    if hit:
        root = w[: -len(hit) + 1] if hit in ("sion", "tion") else w[: -len(hit)]
        w = root if _measure(root) > 1 else w
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def text_search(docs: DataFrame, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, rank: documents (doc_id, text) that hold every term of q, ranked by BM25; counts cover all documents.

    Words are runs of a-z and 0-9 in lower case; stopwords go, and words count by their stem. Only words that begin like a term are stemmed, so
    few leave the JVM. A q of stopwords alone finds nothing.
    """
    terms = sorted({stem(t) for t in re.split(_WORD, q.lower()) if t and t not in SEARCH_STOPWORDS})
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("rank")).limit(0)
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _WORD), lambda w: (w != "") & ~w.isin(*SEARCH_STOPWORDS))
    begins = lambda w: reduce(Column.__or__, [w.startswith(t[: max(1, len(t) - 1)]) for t in terms])
    rows = docs.select("doc_id", tokens.alias("w")).select("doc_id", F.size("w").alias("n"), F.filter("w", begins).alias("w"))
    rows = rows.withColumn("w", _stems("w")).select("doc_id", "n", *[_times("w", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    total = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = rows.join(F.broadcast(total))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        rows = rows.filter(tf > 0)
        score = score + F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("avg_n")))
    return rows.select("doc_id", score.alias("rank"))


def search_jobs(jobs: DataFrame, companies: DataFrame, q: str) -> DataFrame:
    """Active jobs whose title and description hold every term of q, with their company; best first, then newest."""
    text = F.concat_ws(" ", "title", F.coalesce("description_text", F.lit("")))
    found = text_search(jobs.filter("is_active").select(F.col("id").alias("doc_id"), text.alias("text")), q).withColumnRenamed("doc_id", "id")
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("slug").alias("company_slug"))
    return jobs.join(found, "id").join(named, "company_id").orderBy(F.desc("rank"), F.desc("first_seen_at"), "id")


def merge_evidence(reports: DataFrame, canonical: DataFrame) -> DataFrame:
    """canonical_id, urls, source_count, confidence, evidence of each canonical event: a report whose URL was seen before changes nothing, not even the confidence.

    confidence is the greatest of the reports that brought a new URL (null without such a column); evidence their URLs in the order they came.
    """
    sure = F.col("confidence") if "confidence" in reports.columns else F.lit(None).cast("double")
    rows = reports.select("id", "source_url", sure.alias("confidence")).join(canonical, "id")
    first = rows.groupBy("canonical_id", "source_url").agg(F.min("id").alias("first"), F.min_by("confidence", "id").alias("confidence"))
    evidence = F.transform(F.array_sort(F.collect_list(F.when(F.col("source_url").isNotNull(), F.struct("first", "source_url")))), lambda e: e["source_url"])
    return first.groupBy("canonical_id").agg(F.count_if(F.col("source_url").isNotNull()).alias("urls"), F.count("*").alias("source_count"), F.max("confidence").alias("confidence"), evidence.alias("evidence"))


def embed_table(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float] | None]], dim: int, batch: int = 50) -> DataFrame:
    """The table with ``embedding`` (array<float>, unit length): each distinct text goes once to ``embed``, in lists of at most ``batch``, and comes back to all its rows.

    ``embed`` answers in order. A null or blank text, a failed call, an answer of another length than its list, and a null, zero or wrongly wide vector give null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                texts = pdf["__tm_text"].tolist()[i : i + batch]
                try:
                    found = list(embed(texts))
                except Exception:  # noqa: BLE001  a provider's failure is a result here: null vectors
                    found = []
                found = found if len(found) == len(texts) else [None] * len(texts)
                yield pd.DataFrame({"__tm_text": texts, "embedding": [_unit(v, dim) for v in found]})

    texts = df.select(F.col(text).alias("__tm_text")).filter(F.trim(text) != "").distinct()
    return df.join(texts.mapInPandas(run, "__tm_text string, embedding array<float>"), F.col(text) == F.col("__tm_text"), "left").drop("__tm_text")


def _unit(values: list[float] | None, dim: int) -> np.ndarray | None:
    v = np.asarray(values if values is not None else [], np.float64)
    norm = np.linalg.norm(v)
    return (v / norm).astype(np.float32) if len(v) == dim and np.isfinite(norm) and norm > 0 else None
