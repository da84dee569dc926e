"""Documents to a tokenised training mix: five stages, each written as Parquet and read by the next.

Toxic documents go; of equal texts, and of groups with near fingerprints, one stays; words are then drawn so that
sources meet their target weights, which leaves one row for each document and pass over its source; the last stage
encodes each row and decodes it again.
"""

from __future__ import annotations

from histora.llm import bpe, exact_dedup, mixing, simhash, toxicity
from histora.llm.common import table, written


def toxic_out(spark, docs, sf_dir):
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def copies_out(spark, docs, sf_dir):
    return exact_dedup.keep_one(docs)


def near_copies_out(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def mixed(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", copies_out),
    ("SimHash near-dedup", near_copies_out),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]
#: Ordinal regression, SimHash and pseudorandom draws have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else written(docs, "stage"), sf_dir)
    return docs
