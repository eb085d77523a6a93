"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.gazetteer import entity_rows, learn, learn_variants
from threadloom.llm.languages import document_languages, fit_model, language_segments
from threadloom.llm.lookalikes import look_classes, normalized, same_look_pairs
from threadloom.llm.names import entity_mentions, lexicon_of, link_names, variant_pairs
from threadloom.llm.packing import fill_report, pack
from threadloom.llm.personal import SpanModel, masked_texts, personal_spans
from threadloom.llm.personal import fit_model as fit_span_model
from threadloom.llm.quality import load_common_words, text_statistics
from threadloom.llm.sentences import sentence_units
from threadloom.llm.tokens import encode_corpus, token_counts
from threadloom.session import ship
from threadloom.sources.tables import latest_delivery, latest_wide, spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, raw_text) of the source documents, each once."""
    ship(spark)
    scan = table(spark, d, "source_documents").select("id", "ingested_at", "raw_text")
    return spread(latest_wide(scan).filter("raw_text IS NOT NULL").select("id", "raw_text"), scan)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) of the corpus."""
    ship(spark)
    scan = table(spark, d, "documents").select("doc_id", "text")
    return spread(scan, scan)


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(_texts(spark, d), fit_model(table(spark, d, "lang_samples"), table(spark, d, "common_words")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_segments(spark, d).select("document_id", "seg_no", "lang")


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(p1_segments(spark, d))


def _span_model(spark: SparkSession, d: str) -> SpanModel:
    known = learn(entity_rows(table(spark, d, "entities")))
    return fit_span_model(table(spark, d, "source_documents"), known, load_common_words(table(spark, d, "common_words")))


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(_texts(spark, d), _span_model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_spans(spark, d).drop("probability")


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of what identifies a person."""
    return masked_texts(_texts(spark, d), _span_model(spark, d))


def _texts_of_intakes(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = None
    for name in ("entities", "source_documents"):
        t = table(spark, d, name).select(F.concat_ws(":", F.lit(name), "intake_id").alias("scope"), "id", F.col("raw_text").alias("text")).filter("intake_id IS NOT NULL")
        rows = t if rows is None else rows.unionByName(t)
    return rows


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = same_look_pairs(_texts_of_intakes(spark, d))
    return pairs.select(F.substring_index("scope", ":", 1).alias("src_table"), "id_a", "id_b")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row whose text is also spelled with other characters in its intake, with its class and the class's size."""
    c = look_classes(_texts_of_intakes(spark, d))
    return c.select(F.substring_index("scope", ":", 1).alias("src_table"), F.expr("substring(scope, instr(scope, ':') + 1)").alias("intake_id"), "id", "class_id", "n_rows", "n_spellings")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every mention."""
    ship(spark)
    rows = latest_delivery(table(spark, d, "entities").select("id", "raw_text", "ingested_at"))
    return normalized(rows, "raw_text").select("id", "consistent_text")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The rows of persons and organisations with their entity; given names and short forms are learnt of all mentions."""
    ship(spark)
    entities = table(spark, d, "entities")
    mentions = entity_rows(entities)
    known = learn(mentions)
    lexicon = lexicon_of(known, learn_variants(mentions, known))
    return link_names(entity_mentions(entities.filter("entity_type IN ('PERSON', 'ORGANIZATION')")), lexicon)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(_named(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each named row with the entity it belongs to and how many rows that has."""
    links = _named(spark, d)
    sizes = links.groupBy("scope", "kind", "entity").agg(F.count("*").alias("n_rows"))
    return links.join(sizes, ["scope", "kind", "entity"]).select(F.col("scope").alias("intake_id"), "kind", "id", "entity", "n_rows")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(_texts(spark, d)).select("document_id", "start_char", "end_char")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_documents(spark, d))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document, and its characters to a token."""
    return token_counts(_documents(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    profiles = [(r[0], r[1]) for r in table(spark, d, "pack_capacities").select("profile_id", "capacity_tokens").collect()]
    return pack(token_counts(_documents(spark, d)), profiles, "doc_id", "n_tokens", table(spark, d, "documents").count())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnsRenamed({"item_id": "doc_id", "start_unit": "start_token", "n_units": "n_tokens"})


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(_documents(spark, d), load_common_words(table(spark, d, "common_words")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).filter(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


_ALL = (p1_found, p1_segments, p1_documents, p2_found, p2_spans, p2_masked, p3_found, p3_classes, p3_entities, p4_found, p4_entities, p6_found)
_ALL += (p8_ids, p8_counts, p9_containers, p9_report, p10_found, p10_statistics)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {}
