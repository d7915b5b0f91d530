"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. ``run`` writes the result of each stage to the shared folder and reads it
again, so a lost executor repeats one stage at most.

All stages but the last return the columns of their input, whatever other columns
there are and whatever they are called. Null texts count as empty ones, null keys as
keys like any other, texts are read whole at any length, and an empty table stays
empty. Repeated rows are judged alike; the stage of near copies leaves one of them.
"""

from pyspark.sql import functions as F

from quillspark.llm import decontaminate, nearcopies, pieces, quality, sentencepieces, toxicity
from quillspark.llm.catalog import table, tokenizer_path
from quillspark.session import settle


def drop_toxic(spark, docs, sf_dir):
    """Documents that score as toxic go; the model learns from labelled rows of ``docs``."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def drop_poor(spark, docs, sf_dir):
    """Documents below the quality threshold go."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays, that with the smallest id."""
    return nearcopies.keep_one(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """``doc_id, ids, same, n_ids``: the piece ids of each document, and whether they decode to its text."""
    vocabulary = pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    return sentencepieces.encode_pieces(docs, vocabulary, compare=True).withColumn("n_ids", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

# Trained models and automata are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
