"""A pipeline over training documents: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the docs of the next.
All but the last return the columns of ``documents``; the last returns the packed pieces. Empty tables pass through. A
stage first gives up the scratch tables of the stages before, whose results are written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cborlake.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from cborlake.llm.common import materialize, release, table
from cborlake.llm.queries import TOXIC, learns_toxicity, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL can express learning and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go. Rows, repeated ones too, are judged by their texts, one by one."""
    release(docs)
    model = toxicity.model_of(docs, table(spark, sf_dir, "labels"), learns_toxicity)
    return toxicity.keep_below(docs.select(*COLUMNS), model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more one stays, that of the least id."""
    release(docs)
    return ngram_join.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 50 that start in a document of a smaller id are cut out. Where a cut parts a character,
    what is left of it goes as well; n_chars is counted anew for texts that changed, all other values stay."""
    release(docs)
    out = suffix_dedup.remove_repeats(docs, keep=COLUMNS, as_text=True)
    n_chars = F.when(F.size("spans") > 0, F.char_length("rest").cast("long")).otherwise(F.col("kept.n_chars"))
    text = F.when(F.size("spans") > 0, F.col("rest")).otherwise(F.col("kept.text"))
    return out.select("kept.doc_id", text.alias("text"), "kept.lang", "kept.source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy the mix takes, in order of training position."""
    release(docs)
    return mixing.arrange(docs.select(*COLUMNS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    release(docs)
    cut = packing.pieces(docs, tokenizer_path())
    placed = packing.assign(cut, ids_crc32=F.crc32("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; between them each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, scratch=False)
    return STAGES[-1][1](spark, docs, sf_dir)
