"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage gets what its predecessor kept, read back from Parquet, and its decisions take effect:
language ID rejects texts without a letter and those whose best language is hardly likelier than by
chance; line dedup takes lines out that ten documents or more share; near-dedup leaves one document
of each group (five-word shingles, similarity 0.8 or more); decontamination drops contaminated
documents; packing lays the rest out in sequences. All but the last return the columns of
`documents`, whatever other columns the table has.

Defined cases, stage by stage: null and empty texts have no letter and go in the first stage. A text
that line dedup empties stays, as an empty text (n_chars 0), and becomes one piece of the end id.
Rows repeated as a whole are one document after near-dedup. Null doc_ids pass through all stages; a
null lang teaches nothing, a null source or n_chars means nothing. Texts of any length are read
whole. An empty table gives no rows. `lang` is learned from, never read by the decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from plexigraph.llm._common import clear_stashed, release, stash, stashed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if its best language scores under LIFT times the odds of one language among all: the model
#: has no idea then. (Four languages: 0.3. Scores are calibrated; at sf0.1 the least of all documents is 0.33, while
#: texts in scripts that no document has score 0.28 to 0.30.)
LIFT = 1.2
#: Words that packing's workers remember: fewer than its default, as executors have run four stages before.
KEPT_WORDS = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.filter(language_id.remainder("doc_id", 3) != 1))
    return language_id.keep_known(docs, model, LIFT / len(model.langs) if model else 0.0)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return near_dedup.dedup_near(docs.select(*COLUMNS), words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return packing.pack_documents(docs, kept_words=KEPT_WORDS)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_common_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Language ID, near-dedup and packing have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stashed()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear_stashed(spark, since=before, keep=1)  # all but this stage's table
    return STAGES[-1][1](spark, docs, sf_dir)
