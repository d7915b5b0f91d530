"""The numbered queries over the given tables."""

from pyspark.sql import functions as F

from . import counts, decontaminate, language, neighbours, pieces, prefixtrie, quality, sentencepieces, simhash, tokens, toxicity, variants, vectorcopies, warc
from .common import fold
from .oracles import ORACLES


def tokenizer_path(name):
    """Where the public vocabulary files lie; they are read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = quality.train_quality(docs, labels, learn=~held_out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    model = toxicity.train_toxicity(docs, labels, learn=~held_out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.train_language(docs, learn=~held_out)
    found = language.language_spans(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op1_warc(spark, sf_dir):
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").cast("long").alias("refers_to"),
    )


def op4_tokens(spark, sf_dir):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    return tokens.round_trip(table(spark, sf_dir, "documents"), spec)


def op5_token_counts(spark, sf_dir):
    vocabulary = pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    return counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op7_sentencepiece(spark, sf_dir):
    vocabulary = pieces.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op11_prefix_trie(spark, sf_dir):
    """A row per node of the trie of rebuilt conversations; nulls, ties and empty tables as ``prefix_trie`` states."""
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_copies(spark, sf_dir):
    """A row per vector with its links and component; a row of null id is not kept."""
    found = vectorcopies.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_variants(spark, sf_dir):
    """A row per word with its form and root; nulls, ties and empty tables as ``spelling_variants`` states."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_warc, op2_quality, op3_simhash, op4_tokens, op5_token_counts, op6_toxicity, op7_sentencepiece, op8_language, op9_decontaminate, op10_neighbours, op11_prefix_trie, op12_vector_copies, op13_variants, pipeline)
QUERIES = {f.__name__: f for f in _ALL}
__all__ = ["ORACLES", "QUERIES"]
