"""The pN_ queries of the operators for training data, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.defects import broken_pairs
from tidemark.llm.neardup import expand_links, near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import JVM_END, JVM_LINE, JVM_SPACE, JVM_WORD, classify_documents, document_statistics
from tidemark.llm.splitting import split_oversized
from tidemark.llm.tokens import encode_texts
from tidemark.llm.turns import speaker_turns, turn_cases
from tidemark.llm.vectors import similar_vectors
from tidemark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five events with the most similar embedding of every usable event."""
    return similar_vectors(table(spark, sf_dir, "visual_events"), "event_id", "embedding").select("event_id", F.col("neighbor").alias("neighbor_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe with a defective answer, and the defect."""
    return broken_pairs(table(spark, sf_dir, "iterm_probes"), table(spark, sf_dir, "common_words"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims linked by SUPPORTS or CONTRADICTS pairs (apart from case and outer blanks), with their group's smallest claim."""
    holds = F.upper(F.trim("relation")).isin("SUPPORTS", "CONTRADICTS")
    pairs = table(spark, sf_dir, "contradiction_pairs").where(holds)
    out = connected_components(pairs, F.col("claim_a"), F.col("claim_b"))
    return out.select(F.col("node").alias("claim_id"), F.col("group").alias("group_id"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every transcript of more than 1,000 characters, with their shares of the moment's span."""
    return split_oversized(table(spark, sf_dir, "moments"), "moment_id", "transcript", "t_start_s", "t_end_s")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split moment, and whether its cuts are all at sentences' ends."""
    return p5_pieces(spark, sf_dir).where("piece = 0").select("moment_id", "cut")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue with spoken words, the first cue of its turn and its speaker."""
    cases = turn_cases(table(spark, sf_dir, "segments"), table(spark, sf_dir, "speakers"))
    return cases.select("seg_id", "turn_seg_id", "speaker_id")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean turns of every video, with their text."""
    return speaker_turns(table(spark, sf_dir, "segments"), table(spark, sf_dir, "speakers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of claims and pairs of moments whose sets of adjacent word pairs have at least half of their union in common."""
    out = []
    for kind, name, key, text in (("claim", "claims", "claim_id", "text"), ("moment", "moments", "moment_id", "transcript")):
        pairs = expand_links(*near_duplicates(table(spark, sf_dir, name), key, text))
        out.append(pairs.select(F.lit(kind).alias("record_type"), "record_a", "record_b"))
    return out[0].unionByName(out[1])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k; null and empty texts give an empty list."""
    return encode_texts(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")).withColumnRenamed("key", "doc_id")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of a longer one, with its container of 2,048 tokens by byte_bpe_50k."""
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    out = classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return out.where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count, mean word length and the shares of symbols, punctuated lines and common words of every document."""
    return document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_pieces": p5_pieces, "p5_found": p5_found, "p6_found": p6_found, "p6_turns": p6_turns, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_statistics": p10_statistics}


def oracle_sql() -> dict:
    return SQL


_quoted = lambda s: "'" + s.replace("'", "''") + "'"

SQL = {
    "p10_statistics": f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(lower(t), {_quoted(JVM_WORD)}) w, list_filter(string_split_regex(t, {_quoted(JVM_LINE)}), lambda x: regexp_matches(x, {_quoted(f"[^{JVM_SPACE}]")})) l,
 length(regexp_replace(t, {_quoted(f"[{JVM_SPACE}]")}, '', 'g')) solid, length(regexp_replace(t, {_quoted(f"[{JVM_SPACE}" + r"\p{L}\p{N}]")}, '', 'g')) symbols from d),
c as (select list(distinct lower(word)) cs from common_words where word is not null)
select doc_id, len(w)::bigint as n_words, case when len(w) > 0 then length(array_to_string(w, ''))::double / len(w) else 0 end as mean_word_len, case when solid > 0 then symbols::double / solid else 0 end as symbol_ratio,
 case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, {_quoted(JVM_END)})))::double / len(l) else 0 end as punct_line_share,
 case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(cs, x)))::double / len(w) else 0 end as common_share from w, c
""",
    "p4_found": """
with recursive l as (
  select distinct claim_a a, claim_b b from contradiction_pairs
  where upper(trim(relation)) in ('SUPPORTS', 'CONTRADICTS') and claim_a is not null and claim_b is not null and claim_a <> claim_b),
e as (select a, b from l union select b, a from l),
reach as (select a n, a m from e union select r.n, e.b from reach r join e on r.m = e.a)
select n as claim_id, min(m) as group_id from reach group by n
""",
    "p5_found": """
with m as (select moment_id, any_value(transcript) t from moments where length(transcript) > 1000 group by moment_id),
c as (select moment_id, replace(regexp_replace(t, '([.!?…]+)([\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\pZ])', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)) t from m)
select moment_id, case when list_max(list_transform(string_split(t, chr(1)), lambda x: length(x))) > 1000 then 'forced' else 'natural' end as cut from c
""",
}
