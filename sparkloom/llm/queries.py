"""The thin queries over the operators of this subpackage, by name: (spark, folder of tables) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, collocations, decontaminate, licenses, mixing, near_dedup, pii, sharding, substring_dedup, token_store, toxicity, vector_dedup
from .sql import SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a document's whole text is, and those that its lines name."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written as Re-Pair shards and read back."""
    import public_tokenizers

    shards = token_store.token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digests(shards)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items whose tiles cover half of the item or more."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "matched", "tiles", F.round("coverage", 6).alias("coverage"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of similarity 0.8 or more connect."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by keyed surrogates."""
    return pii.replace(_table(spark, sf_dir, "documents"), key="registered-query-key")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, sources weighing 1, 2, 3 in turn."""
    quality = mixing.label_quality(_table(spark, sf_dir, "labels"))
    out = mixing.mix(_table(spark, sf_dir, "documents"), quality)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after every window of 35 words that also starts elsewhere is removed."""
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model fitted to labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), leaves=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all vectors, and their components."""
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language."""
    found = collocations.top_phrases(collocations.phrases(_table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by two tokenizers, aligned, with the corpus-wide counts of linked ids."""
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, formatted, written, and read back."""
    quoted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.written(rows))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_repair_tokens, op3_decontaminate, op4_near_dedup, op5_pii_surrogates, op6_mix, op7_substring_dedup, op8_toxicity, op9_shard, op10_vector_dedup, op11_collocations, op12_align, op13_chat)
}
