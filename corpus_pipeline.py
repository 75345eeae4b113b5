"""A corpus-preparation pipeline of the operators in ``echoquorum.llm``.

Each stage takes what its predecessor kept, as Parquet, and returns whole rows of ``documents``; the last returns the
list of tokens per document, read back from the files it wrote. All stages take nulls in any column, empty and very long
texts, repeated rows and columns of any further names, which are carried along as they are; an empty table gives an
empty result. What each makes of these cases stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoquorum.llm import decontaminate, mixing, quality, simhash, tokens
from echoquorum.llm.common import drop_scratch, new_path, scratch_scope
from echoquorum.llm.queries import MIX_SEED, WEIGHTS, domain_of, word_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go.

    A null, empty or wordless text fails; rows without a source are one host; repeated rows are judged one by one.
    """
    return quality.filter_quality(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, a similarity of 0.8 or more) the document of the least id stays.

    A row without an id stays only where no row of its group has one; of equal rows one stays; texts without words are
    one group. Candidates are the components of SimHash fingerprints within 4 bits, and MinHash bands for the copies that are further
    apart (README); each link is verified.
    """
    return simhash.drop_similar(docs, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go; texts without words stay, repeated rows are judged one by one."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture has as many words as come in; a document that its leaf reads twice is there twice.

    A null lang or source is the empty name; texts without words are never chosen; repeated rows are chosen one by one.
    """
    return mixing.mix_rows(docs, WEIGHTS, max_epochs=2, seed=MIX_SEED, domain=domain_of(F.col("source")))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns (doc_id, start, n_tokens, ids_crc32) as read back from them.

    A null text is empty and has the end id alone; rows without an id come first; every row has its own ids. Other columns
    play no part.
    """
    return tokens.read_tokens(tokens.write_tokens(docs, word_tokenizer()))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", tokens_stage),
]

#: SQL can't express the SimHash and token stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, path = docs, new_path(spark, f"stage-{k}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs._scratch_path = path
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
