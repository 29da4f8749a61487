"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countinghouse.llm import (
    bpe,
    conversations,
    html_template,
    lattice,
    licenses,
    line_frequency,
    line_spread,
    nbsvm,
    packing,
    pii,
    simhash,
    spelling,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_naive_bayes_svm(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    model = nbsvm.train(docs, labels, usable=fold != 0)
    scores = nbsvm.scored(docs.withColumnRenamed("doc_id", "id"), model, id_col="id")
    return scores.select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold == 0, F.lit(True)).alias("held_out"),  # no label is learnt without an id
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.verdicts(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        *line_frequency.MEASURES,
        "base_failed",
        "kept",
        "words_left",
    )


def op4_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    ).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op5_uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(
        table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=256
    )


OP5_SQL = """
with v as (
    select vec_id,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(range(1, 1 + least(len(q.e), len(c.e))),
            lambda i: q.e[i] * c.e[i])) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


def op6_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    return line_spread.remove_spread_lines(
        table(spark, folder, "documents"), removed_col="n_removed"
    ).select("doc_id", "text", "n_removed")


_KINDS_OF_COMPANY = ", ".join(
    f"""count(distinct case when md5(norm)[{at}:{at + 7}] = m{at}[1] then m{at}[2] else m{at}[1] end)"""
    for at in (1, 9, 17, 25)
)
OP6_SQL = f"""
with lines as (
    select d.rowid as row, doc_id, source, n, line,
        case when trim(line) <> '' then lower(trim(line)) end as norm
    from (select row_number() over () as rowid, * from documents) d,
        unnest(string_split(text, chr(10))) with ordinality as u(line, n)
), marks as (
    select row, {", ".join(
        f"list_sort(list(distinct md5(norm)[{at}:{at + 7}])) as m{at}" for at in (1, 9, 17, 25)
    )}
    from lines where norm is not null group by row
), spread as (
    select norm from lines join marks using (row) where norm is not null
    group by norm
    having count(distinct source) > {line_spread.MAX_SITES}
        and greatest({_KINDS_OF_COMPANY}) > {line_spread.MAX_SITES}
), flagged as (
    select row, doc_id, n, line, norm in (select norm from spread) as gone from lines
)
select doc_id,
    case when count(*) filter (gone) > 0 and count(*) filter (not gone) > 0
        then string_agg(line, chr(10) order by n) filter (gone is not true)
        else string_agg(line, chr(10) order by n) end as text,
    cast(case when count(*) filter (not gone) > 0 then count(*) filter (gone) else 0 end as bigint)
        as n_removed
from flagged group by row, doc_id
"""


def op7_candidate_boosting(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def joined(spans: str) -> Column:
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ","
        )

    return pii.detect(docs, pii.train(docs)).select(
        "doc_id",
        *(
            F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
            for kind in pii.KINDS
        ),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op8_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(
        table(spark, folder, "documents"), words=4, distance=4
    ).select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op10_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.main_text(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op11_trie_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling.runs(table(spark, folder, "documents"))
    # Every 199th run by hash loses a code point.
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run")
    mark = F.crc32(name.cast("binary"))
    at = (mark % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(mark % 199 == 0, less).otherwise(F.col("run")).alias("word"))
    long = words.filter(F.length("word") >= spelling.LEAST_LENGTH)
    return spelling.variants(spelling.counted(long))


def _damaged(turns: DataFrame) -> DataFrame:
    """Conversations with some turns dropped, emptied, cut, repeated or given to the user."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = (
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", ""))
        .otherwise(filled("text"))
    )
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return turns.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def op12_grammar_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = conversations.repair(_damaged(turns)).withColumnRenamed("conv_id", "found")
    known = F.col("conv_id").eqNullSafe(F.col("found"))
    zeros = [
        F.coalesce(F.col(name), F.lit(0)).alias(name)
        for name in ("gaps", *conversations.COUNTS, "cost")
    ]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return turns.select("conv_id").distinct().join(found, known, "left").select(
        "conv_id",
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


def op13_lattice_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


def queries() -> dict[str, Query]:
    return {
        "op1_byte_level_bpe": op1_byte_level_bpe,
        "op2_naive_bayes_svm": op2_naive_bayes_svm,
        "op3_line_frequency": op3_line_frequency,
        "op4_mixture_packing": op4_mixture_packing,
        "op5_uniform_threshold": op5_uniform_threshold,
        "op6_line_spread": op6_line_spread,
        "op7_candidate_boosting": op7_candidate_boosting,
        "op8_license_rules": op8_license_rules,
        "op9_simhash": op9_simhash,
        "op10_site_templates": op10_site_templates,
        "op11_trie_pairs": op11_trie_pairs,
        "op12_grammar_repair": op12_grammar_repair,
        "op13_lattice_hashing": op13_lattice_hashing,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express."""
    return {"op5_uniform_threshold": OP5_SQL, "op6_line_spread": OP6_SQL}
