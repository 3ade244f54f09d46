"""From raw documents to encoded training text: five stages, each applying one operator to all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import decontaminate, near_dup, piece_bpe, quality, queries, secrets
from tapewright.llm.batches import free_name
from tapewright.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept, with all their columns.

    Null and empty texts are too short and go; repeated rows are judged alike. An empty table stays empty.
    """
    judged = quality.quality(docs, keep=tuple(docs.columns))
    return judged.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others, with all their columns.

    Rows with the same id are one document: the one with the least text stays (ties: least other columns in order,
    columns with maps as JSON). Rows without an id stay, and so do documents without words. An empty table stays empty.
    """
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    order = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rest]
    least = F.min_by(F.struct("text", *[f.name for f in rest]), F.struct("text", *[c.alias(f"c{i}") for i, c in enumerate(order)]))
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(least.alias("row"))
    known = one.join(kept, "doc_id", "left_semi").select(*["doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns])
    return known.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, with all their columns.

    Null and empty texts contain nothing and stay; repeated rows are searched each. An empty table stays empty.
    """
    leaks = free_name("leaks", docs.columns)
    return decontaminate.contained(docs, queries.benchmark(spark, sf_dir), name=leaks).where(F.size(leaks) == 0).drop(leaks)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars``, where there is one, is counted anew for these.

    Null and empty texts stay as they are; repeated rows are masked each. An empty table stays empty.
    """
    spans = free_name("secrets", docs.columns)
    masked = free_name("masked", [*docs.columns, spans])
    found = secrets.find_secrets(docs, name=spans).withColumn(masked, secrets.redacted("text", spans))
    new = {"text": F.col(masked)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.char_length(masked).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests: a row per row, other columns are left out.

    Null and empty texts have no ids and decode to nothing. An empty table gives no rows.
    """
    return queries.piece_digests(piece_bpe.encode_decode(docs, queries.PIECES))


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("encoding", encode),
]
#: SentencePiece encoding has no SQL form; tests/llm/test_pipeline.py checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what a stage keeps is written once and read by the next."""
    docs = queries.documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
