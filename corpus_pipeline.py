"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage works on all that the one before it kept. Its result is written as
Parquet under the shared folder and read again as the next one's documents; what
it wrote besides is deleted then.

All stages take documents of the columns DOCUMENT_COLUMNS, whatever others there
are. Null and empty texts pass the first three (they are not toxic, like no other
and not contaminated) and are never taken by the mix, since they have no words.
Rows that repeat an id with other texts are judged one by one by the first three
stages; of rows that agree in id and text the second keeps one. Ties go to the smaller id, then to the lesser text. A
null id, source or language is a value like others. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvatide.llm import decontaminate, mixing, partenum, token_output, toxicity
from silvatide.llm.tables import delete, only, swept, table, written

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores 0.5 or more go. It is learned from the labels outside the held fold; without any nothing goes."""
    return toxicity.drop_toxic(only(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, the one of least id stays. Rows without an id stay."""
    return partenum.keep_one(only(docs, *DOCUMENT_COLUMNS))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go; the others stay as they are."""
    return decontaminate.drop_contaminated(only(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times. Rows that agree in id, source and text are taken alike."""
    return mixing.mixed(only(docs, *DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as wavelet matrices of token ids, described by document as read back: a row for each copy of a document."""
    return token_output.read_documents(token_output.write_tokens(docs, token_output.tokenizer_path()))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", reject_contaminated),
    ("mixing", mix),
    ("token_output", tokens),
]

#: SQL can express neither the field of the first stage nor the byte-pair encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with swept(spark) as kept:
            docs = written(spark, stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            delete(spark, before)
        before = docs
    return docs
