"""A training corpus from documents: known language, near duplicates and repeats gone, clean of benchmarks, as tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.bpe import encode_decode
from lorekeep.llm.common import cut, read_table
from lorekeep.llm.decontam import decontaminate
from lorekeep.llm.langid import fit, identify
from lorekeep.llm.merkle import ranked, with_rank
from lorekeep.llm.minhash import near_duplicates
from lorekeep.llm.suffix_dedup import remove_repeats


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which `lang` tells from now on if it was null. Those of null or empty text or without a letter go;
    documents of several languages stay; repeated rows all stay or all go. Columns may have any names."""
    labelled = identify(docs.select("text", F.struct(*docs.columns).alias("doc")), fit(docs), carry=("doc",)).where("lang_pred <> 'und'")
    return labelled.select(*[F.coalesce("doc.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of smallest doc_id; every text that goes is near a chain of texts to one that stays.

    Where a doc_id has several texts, each of them is grouped as a document of its own, so none goes because of another. Rows without
    doc_id and documents without words stay; of repeated rows (equal doc_id and text) one stays, but rows without
    doc_id all stay. Columns may have any names.
    """
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = near_duplicates(known, shingle=5, percent=80).where("not kept").select("doc_id")
        return known.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(unknown)
    packed = known.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", F.xxhash64("text").alias("mark"), F.struct(*docs.columns).alias("doc"))
    ranks = with_rank(*ranked(packed.select("doc_id", "mark"), [], ["doc_id", "mark"]), []).select(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark"), "rank")
    each = cut(packed.join(ranks, (F.col("doc_id") == F.col("r_id")) & (F.col("mark") == F.col("r_mark"))).select(F.col("rank").alias("doc_id"), "text", "doc"))
    gone = near_duplicates(each, shingle=5, percent=80).where("not kept").select("doc_id")
    kept = each.join(gone, "doc_id", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`") for c in docs.columns]).unionByName(unknown)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; characters stay whole, n_chars follows.

    Every row stays, of null or empty text too (then empty). Rows without doc_id are later than all others. Columns may have any names.
    """
    made = remove_repeats(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("doc")), whole_characters=True, carry=("doc",))
    text = F.col("kept").cast("string")
    new = {"text": text.alias("text"), "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return made.select(*[new[c] if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those of null or empty text stay, repeated rows all stay or all go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decodes): token ids as little-endian unsigned 32-bit integers, and whether they decode to the text.

    Null and empty texts have no ids; every row is returned.
    """
    import public_tokenizers

    made = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=True)
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("benchmarks", without_benchmarks),
    ("tokens", tokens),
]

#: SQL cannot express language identification or tokenization; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
