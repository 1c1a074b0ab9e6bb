"""One query for each operator, over its whole table."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import fim, linefreq, media, minhash, mixing, oracles, pieces, piecemodel, pii, simhash, spans, spelling, toxicity, urls, wordpiece

#: Folder of the public tokenizer files; read on the driver only.
TOKENIZERS = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


@_query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles in 256 bins of 8 bits, for each text, its edited text and the next document."""
    return minhash.edited_likeness(_table(spark, sf_dir, "documents"), width=5)


def _piece_file() -> bytes:
    return Path(TOKENIZERS, "piece_bpe_32k.model").read_bytes()


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths with the pieces of the public 32k vocabulary."""
    pieces = piecemodel.vocabulary(piecemodel.parse(_piece_file()))
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), pieces, piecemodel.MARK)


#: (verdict, host, beginning of the path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules, else by what its aliases get."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The two labelled categories, low quality before toxic."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, labels, ["low_quality", "toxic"])


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of both categories for every document, and whether the chain rejects it."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_chain(spark, docs, sf_dir)).withColumnRenamed("rejected", "toxic")


def pii_key(spark: SparkSession) -> str:
    """Key of the surrogates, from the environment or the session; without one, the queries run under a key that protects nobody."""
    key = os.environ.get("LEAFMILL_PII_KEY") or spark.conf.get("spark.leafmill.pii.key", None)
    if not key:
        warnings.warn("no key for surrogates is set (LEAFMILL_PII_KEY or spark.leafmill.pii.key): they can be traced back", stacklevel=2)
        return "demonstration"
    return key


@_query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its entities."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, pii_key(spark), counts=True)


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating, and share 150 % of all words; no target above twice its source."""
    found = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, bound=2.0)
    return found.select("doc_id", "size", "source", "source_size", "target", "taken")


@_query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text through a PNG and back, as digests."""
    return media.digests(media.read_media(media.write_media(_table(spark, sf_dir, "documents"))))


@_query
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the sentences gone that a non-first repeated span covers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long: fewer rows go to Python at a time
    found = spans.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_sentences", "n_removed")


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text with the public 32k model, and whether decoding gives the text back."""
    return pieces.encode(_table(spark, sf_dir, "documents"), _piece_file())


@_query
def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in more than 5 % (and more than ten) of a source's documents go; depleted documents are rejected."""
    return linefreq.judge(_table(spark, sf_dir, "documents"), share=0.05, least=10)


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut in three and put together anew, and back."""
    done = fim.restore(fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least five code points and three occurrences, each under its most frequent near word."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


ORACLES |= {"op11_line_frequency": oracles.LINE_FREQUENCY, "op12_fill_in_middle": oracles.FILL_IN_MIDDLE, "op13_spelling_variants": oracles.SPELLING}
