"""The queries opN_<name> and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import oracles
from .common import table


def op1_near_dedup(spark, sf_dir):
    """Near-duplicate groups of ``documents`` on 4-word shingles at 80 percent."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_bpe(spark, sf_dir):
    """Every document encoded and decoded with word_bpe_49k.json."""
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filter(spark, sf_dir):
    """Rule or model verdict for the url of every page."""
    from .url_filter import RULES, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_sharding(spark, sf_dir):
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op5_fingerprints(spark, sf_dir):
    """Context-triggered fingerprints of each document and its edited text."""
    from .ctph import fingerprints_and_edits

    return fingerprints_and_edits(table(spark, sf_dir, "documents"))


def op6_ann(spark, sf_dir):
    """The 20 nearest of every 20th vector by inner product."""
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), 20, 20)


def op7_token_files(spark, sf_dir):
    """Token ids written to wavelet-matrix shards and read back."""
    import public_tokenizers

    from .token_files import read_documents, write_shards
    from .common import new_path

    path = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "token-shards"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_documents(spark, path)


def op8_pii(spark, sf_dir):
    """Base and discovered personal data of every document."""
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    """Every document in a batch of its length bucket."""
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality(spark, sf_dir):
    """Factorisation-machine quality score of every document."""
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clusters(spark, sf_dir):
    """Every vector in the nearest of 8 centroids after 10 rounds."""
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, where each tenth repeats a part of itself."""
    from .periodic import find_runs, repeated

    return find_runs(table(spark, sf_dir, "documents"), repeated)


def op13_quality_rules(spark, sf_dir):
    """Base rules and the isolation forest's verdict for every document."""
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    own = [
        op1_near_dedup, op2_bpe, op3_url_filter, op4_sharding, op5_fingerprints, op6_ann, op7_token_files, op8_pii, op9_packing, op10_quality, op11_clusters,
        op12_periodic_runs, op13_quality_rules,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {"op1_near_dedup": oracles.OP1, "op11_clusters": oracles.op11()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
