"""Operator 2: language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under byte-bigram models, the declared markup language
(how often each language is declared as what, counted over all rows), and a host prior that is smoothed from the whole
through address suffix and registered domain to the host, each level a grouped aggregation of the rows' text
posteriors. A row's own posterior is left out of its host's counts. "und" is one more class: bytes without language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.rows import apart, mark, same
from coppice.llm.url_filter import host_and_path, suffix_and_domain
from coppice.llm.words import LOWER, chunks
from coppice.plans.materialize import table

UND = "und"
#: Bound of the labelled sample that the text models are fitted to, and of the languages.
SAMPLE_ROWS, MOST_LANGUAGES = 4000, 200
#: Bigrams of a text are not independent: their log-likelihood counts this much, and no more than EVIDENCE in all.
TEMPER, EVIDENCE = 0.25, 60.0
STRENGTH = 20.0
SALTS = 16
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def visible(html: Column) -> Column:
    """Text of markup: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, MARKUP, " ")


def declared(html: Column) -> Column:
    """The primary language of the lang attribute of <html>, lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))


#: Letters (A-Z as a-z) and bytes of other scripts; digits, punctuation and white space are all one gap.
PROSE = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint8)
GAP = 32 << 8 | 32


def pairs(data: np.ndarray) -> np.ndarray:
    low = PROSE[data].astype(np.int32)
    return low[:-1] << 8 | low[1:]


def fit(labelled: DataFrame, text: str, language: str) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (languages + und, 65536) from at most SAMPLE_ROWS different rows, those of least hash.

    Only hashes are gathered to find them: no task gets more than its share of the sample's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for row, end, at, data in chunks(batch.column(0)):
                for i in range(row, end):
                    if at[i - row + 1] - at[i - row] > 1:
                        x = np.bincount(pairs(data[at[i - row] : at[i - row + 1]]), minlength=1 << 16)
                        sums[names[i]] = sums.get(names[i], 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], ["language", "counts"])

    kept = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("language"))
    kept = kept.withColumn("h", F.xxhash64("text", "language"))
    # Hashes below a bound that leaves four times as many rows as are wanted; of these the exact bound; then texts.
    rows = labelled.where(F.col(language).isNotNull()).count()
    near = kept if rows <= 4 * SAMPLE_ROWS else kept.where(F.col("h") < int(2.0**64 * 4 * SAMPLE_ROWS / rows) - 2**63)
    last = near.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    sample = near.where(F.col("h") <= (0 if last is None else last)).groupBy("h", "language").agg(F.first("text").alias("text")).select("text", "language")
    counts: dict[str, np.ndarray] = {}
    # few tasks, however the sample was dealt: each sends 512 KB a language to the driver
    for row in sample.coalesce(8).mapInArrow(count, "language string, counts binary").collect():
        counts[row[0]] = counts.get(row[0], 0) + np.frombuffer(row[1], np.int64)
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(counts)
    models = np.zeros((len(names) + 1, 1 << 16), np.float32)
    for i, name in enumerate(names):
        joint = counts[name].reshape(256, 256) + 0.01
        models[i] = np.log(joint / joint.sum(axis=1, keepdims=True)).reshape(-1)
    models[-1] = -np.log(48.0)  # bytes without language: as if 48 characters were equally likely
    models[:, GAP] = 0  # within a gap nothing tells languages apart
    return names, models


def likelihoods(rows: DataFrame, keep: list[str], names: list[str], models: np.ndarray) -> DataFrame:
    """keep columns of rows(text, *keep) and scores: a tempered log-likelihood for each language, then und."""
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(models.T))  # 256 KB a language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            out = np.zeros((batch.num_rows, model.shape[1]))
            for row, end, at, data in chunks(batch.column(0)):
                if len(data) > 1:
                    total = np.zeros((len(data), model.shape[1]))
                    np.cumsum(model[pairs(data)], axis=0, out=total[1:], dtype=np.float64)
                    a, b = at[:-1], np.maximum(at[1:] - 1, at[:-1])
                    ok = at[1:] - at[:-1] > 1
                    out[row:end][ok] = total[b[ok]] - total[a[ok]]
            out *= TEMPER
            out -= out.max(axis=1, keepdims=True)
            np.maximum(out, -EVIDENCE, out=out)
            offsets = pa.array(np.arange(0, out.size + 1, model.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], [*keep, "scores"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select("text", *keep).mapInArrow(score, f"{kinds}, scores array<double>")


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def fuse(rows: DataFrame, keys: list[str], names: list[str], models: np.ndarray) -> DataFrame:
    """keys, language, confidence, text_language of rows(keys, text, declared, host, domain, suffix).

    language is the class of largest posterior; "und" where that is below 0.5. Ties go to the first name. A null text
    has no bigrams, a null declaration or host is a value of its own. One row for each row.
    """
    classes = [*names, UND]
    n = len(classes)
    filled = rows.select(F.coalesce("text", F.lit("")).alias("text"), *keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("declared", "host", "domain", "suffix")])
    scored = likelihoods(filled, [*keys, "declared", "host", "domain", "suffix"], names, models)
    scored = scored.withColumn("said", F.when(F.col("declared").isin(*classes), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("?")))
    scored = scored.withColumn("p", softmax(F.zip_with("scores", F.array(*[F.lit(0.0)] * (n - 1), F.lit(-4.0)), lambda a, b: a + b)))
    scored = table(scored, "language")

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])

    def again(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])

    hosts = table(summed(scored, "host", "domain", "suffix"), "language-hosts")
    domains = again(hosts, "domain", "suffix")
    suffixes = again(domains, "suffix")
    whole = again(suffixes).first()  # a row
    total = sum(whole[i] or 0.0 for i in range(n)) + n
    level = suffixes.select("suffix", *[F.col(f"s{i}") for i in range(n)])
    prior = [F.lit(((whole[i] or 0.0) + 1.0) / total) for i in range(n)]

    def smooth(df: DataFrame, above: list[Column], out: str) -> DataFrame:
        size = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
        return df.withColumn(out, F.array(*[(F.col(f"s{i}") + STRENGTH * above[i]) / (size + STRENGTH) for i in range(n)])).drop(*[f"s{i}" for i in range(n)])

    by_suffix = smooth(level, prior, "suffix_p")
    by_domain = smooth(domains.join(by_suffix, "suffix"), [F.col("suffix_p")[i] for i in range(n)], "domain_p")
    by_host = hosts.join(by_domain.select("domain", "suffix", "domain_p"), ["domain", "suffix"])
    by_host = by_host.select("host", F.array(*[f"s{i}" for i in range(n)]).alias("sums"), "domain_p").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    # Languages x declarations: a table of at most (classes + 2) x classes.
    said: dict[str, np.ndarray] = {}
    for row in summed(scored, "said").collect():
        said[row[0]] = np.array([row[i + 1] or 0.0 for i in range(n)])
    per_class = sum(said.values(), np.zeros(n)) + len(classes) + 2
    table_of = {s: np.log((x + 1.0) / per_class).tolist() for s, x in said.items()}
    flat = np.zeros(n).tolist()
    lookup = F.create_map(*[y for s, x in sorted(table_of.items()) for y in (F.lit(s), F.array(*[F.lit(float(v)) for v in x]))]) if table_of else None

    both = scored.withColumn("salt", F.pmod(F.xxhash64(*keys, "scores"), F.lit(SALTS)).cast("int")).join(by_host, ["host", "salt"])
    size = F.aggregate("sums", F.lit(0.0), lambda s, x: s + x)
    host_p = F.transform(F.arrays_zip("sums", "p", "domain_p"), lambda x: F.greatest(x["sums"] - x["p"], F.lit(0.0)) + STRENGTH * x["domain_p"])
    both = both.withColumn("host_p", F.transform(host_p, lambda x: x / (F.greatest(size - 1, F.lit(0.0)) + STRENGTH)))
    claims = F.element_at(lookup, F.col("said")) if table_of else F.array(*[F.lit(v) for v in flat])
    claims = F.when(F.col("said") == "", F.array(*[F.lit(v) for v in flat])).otherwise(claims)
    both = both.withColumn("claim", claims)
    total_score = F.transform(F.arrays_zip("scores", "claim", "host_p"), lambda x: x["scores"] + x["claim"] + F.log(x["host_p"]))
    both = both.withColumn("posterior", softmax(total_score))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    found = F.element_at(F.array(*[F.lit(c) for c in classes]), best)
    by_text = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("p", F.array_max("p")).cast("int"))
    return both.select(*keys, F.when(F.array_max("posterior") >= 0.5, found).otherwise(UND).alias("language"), F.round(F.array_max("posterior"), 6).alias("confidence"), by_text.alias("text_language"))


def identify_pages(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, language, confidence, text_language, declared evidence fused, for each row of pages.

    labelled(text, lang): rows to fit the text models to. A null html has neither text nor declaration, a null url an
    empty host. Repeated rows each get a result; other columns are ignored.
    """
    names, models = fit(labelled, "text", "lang")
    host, _ = host_and_path(F.col(url))
    suffix, domain = suffix_and_domain(host)
    rows = pages.select(F.col(page_id).alias("page_id"), visible(F.col(html)).alias("text"), declared(F.col(html)).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    return fuse(rows, ["page_id"], names, models)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, lang, source) whose language is identified; lang becomes that language.

    lang is the declared language, source the host. Rows whose posterior is below 0.5 or that are bytes without
    language go. The decision is made for each distinct (doc_id, text, lang, source), so that repeated rows share it;
    texts are told apart by their hash among rows of one doc_id, lang and source, nulls included.
    """
    names, models = fit(docs, "text", "lang")
    id_, mark_, found_ = apart(docs, "id", "mark", "found")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), mark_: mark(F.col("text"))})
    keys = {"k_id": id_, "k_mark": mark_, "k_lang": "lang", "k_source": "source"}
    rows = keyed.select(*[F.col(c).alias(k) for k, c in keys.items()], "text", F.lower("lang").alias("declared"), F.col("source").alias("host"), F.col("source").alias("domain"), F.lit("").alias("suffix"))
    found = fuse(rows, list(keys), names, models).where(F.col("language") != UND).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("language").alias(found_)).dropDuplicates([f"r_{k}" for k in keys])
    both = keyed.alias("d").join(found.alias("r"), same([(F.col(f"d.{c}"), F.col(f"r.r_{k}")) for k, c in keys.items()]))
    return both.select(*[F.col(f"r.{found_}").alias(c) if c == "lang" else F.col(f"d.{c}") for c in docs.columns])
