"""The training-data pipeline: stages over ``documents``, each written and read again.

Stages drop documents without a known language, all but one of each group of
near-duplicates and documents that hold benchmark items, repeat the rest by
their sources' weights, and write token shards, which the last stage reads
back. A stage works on all that the one before kept.
"""

from __future__ import annotations

import uuid

from heliograin.llm import common, decontamination, language_id, simhash_dedup, source_mixing, token_store


def identify_language(spark, docs, sf_dir):
    return language_id.accept(docs, language_id.train(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    return simhash_dedup.keep_first(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    return source_mixing.mix(docs)


def write_tokens(spark, docs, sf_dir):
    import public_tokenizers

    path = token_store.shard_path(spark)
    token_store.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_documents(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_store", write_tokens),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
