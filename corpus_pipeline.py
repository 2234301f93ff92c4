"""From raw documents to packed sequences: language, exact copies, near copies, mixture, packing.

Every stage but the last returns the columns of documents; other columns go, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenceframe.llm import exact_dedup, language, mixing, packing, simhash
from evidenceframe.llm.common import materialise

#: A text is in no language learnt if the best codes no better than raw bytes are and the next is hardly worse, in bits a byte.
RAW_BITS, MARGIN = 8.0, 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the language it is in as its ``lang``; those in none go.

    A document goes if its text is null, empty or without a letter, or if it is in a script of the languages learnt and none of these
    fits. One in another script stays as it is. Labels are learnt from, so a null or wrong one is put right; without any labels
    nothing but letters counts. Repeated rows and ids are judged each.
    """
    scored = language.identify(docs, language.train(docs), carry=tuple(COLUMNS))
    fits = (F.col("bits_per_byte") < RAW_BITS) | (F.col("margin") >= MARGIN) | F.col("margin").isNull()
    kept = scored.where(~F.col("covered") | fits & F.col("covered"))
    own = {c: F.col(f"carry_{i}") for i, c in enumerate(COLUMNS)} | {"text": F.col("text")}
    own["lang"] = F.when(F.col("covered"), F.col("lang_pred")).otherwise(own["lang"])
    return kept.select(*(own[c].alias(c) for c in COLUMNS))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of texts that are equal but for the amount of white space.

    A null id stays only if no other is there; of rows that repeat whole one stays; null and empty texts are equal.
    """
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every component of near copies: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays; a null id only if no other is there. Ids may repeat: rows are told apart by id and text. Of rows
    that repeat whole one stays. Texts that are null or without words are near copies of each other.
    """
    docs = docs.select(*COLUMNS)
    found = materialise(simhash.similar_documents(docs))
    gone = found.where("not kept").select(F.col("row").alias("_row"), F.col("id").alias("_id")).distinct()
    rows = docs.withColumn("_own", simhash.row_hash("doc_id", "text"))
    same = (F.col("_own") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = rows.join(gone, same, "left_anti")
    repeated = materialise(found.where("kept").groupBy("row").count().where("count > 1").select(F.col("row").alias("_row")))
    if not repeated.isEmpty():
        again = kept.join(repeated, F.col("_own") == F.col("_row"), "left_semi").dropDuplicates(["_own", "doc_id"])
        kept = kept.join(repeated, F.col("_own") == F.col("_row"), "left_anti").unionByName(again)
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole copies, then a part where a run begins or ends in it.

    A null source is one of its own, a null text has no words and isn't taken; ids may be null. Rows that repeat whole
    are told apart by number, so each gets its own share.
    """
    docs = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    taken = mixing.mix(docs, row_col="_row").where("taken > 0").select("row", F.col("size").alias("_size"), "begin", "run", "laps")
    met = docs.join(taken.hint("shuffle_hash"), F.col("_row") == F.col("row"))
    # Words with the white space before them; a run may go on at the document's start
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    to_end = F.least(F.col("run"), F.col("_size") - F.col("begin"))
    piece = lambda a, n: F.array_join(F.slice(words, (a + 1).cast("int"), n.cast("int")), "")
    part = F.concat(piece(F.col("begin"), to_end), piece(F.lit(0), F.col("run") - to_end))
    cut = F.when(F.col("run") == F.col("_size"), F.col("text")).when(F.col("run") > 0, part)
    texts = F.concat(F.array_repeat("text", F.col("laps").cast("int")), F.when(F.col("run") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = met.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4,096 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: PPM, SimHash and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
