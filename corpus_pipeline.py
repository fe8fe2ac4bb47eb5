"""The corpus pipeline: documents in, token ids out.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir), works on all
rows its predecessor kept and returns a DataFrame; all but the last return the columns of
documents.  ``run`` applies them in order, each result written as Parquet in the shared folder and
reread as the next stage's documents, so a lost executor costs at most one stage.

Defined results of every stage: null and empty texts are valid documents (the quality rules
reject them); an empty table gives an empty table; further columns are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, mixing, pii, quality_rules, simhash
from fleetlens.llm.common import shared_folder, table, written

TOKENIZER = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged, names = quality_rules.judge(docs, rules)
    return judged.filter(names["kept"]).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return simhash.deduplicated(docs).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind in brackets; ``n_chars`` follows."""
    out, name = pii.redacted(docs)
    new = {"text": F.col(name)} | ({"n_chars": F.length(name).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document appears as often as the mix of sources takes it (never, once or twice)."""
    rows = written(mixing.measured(docs), "mix-rows")   # texts are measured once
    plan = written(mixing.budgets(rows), "mix-plan")
    return (mixing.mixed(rows, plan).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the bytes they decode to."""
    shared_folder(spark)
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER))
    ids, name = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    back, raw, digest = bpe.decoded(ids, ranks, name)
    return back.select("doc_id", "lang", "source", F.col(name).alias("ids"), F.size(name).cast("long").alias("n_tokens"),
                       F.col(digest).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_stage), ("simhash_near_duplicates", near_duplicate_stage), ("pii", pii_stage),
          ("mixing", mixing_stage), ("bpe", encoding_stage)]

#: Learned rules, fingerprint components, span scores and merges can't be stated in SQL;
#: tests/llm compares every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
